"""Editions: hydrated stories, dockets, hero, statistics, columns, lenses, tags and differences."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..functions import url as U
from .cluster import is_graph
from .views import shown


def items(stories: DataFrame, views: DataFrame, limit: int = 30, spare: int = 10) -> DataFrame:
    """The best stories whose lead can be shown, at ``pos`` 0 and on, with what readers see of the lead.

    ``views`` are nested views of posts; of stories without one ``spare`` can be made up for.
    """
    top = stories.orderBy(F.desc("cluster_score"), "type_rank", "first_rank").limit(limit + spare)
    wanted = F.broadcast(top.select(F.col("lead_post_uri").alias("uri")))  # limit + spare rows
    seen = shown(views.join(wanted, "uri", "left_semi")).withColumnRenamed("uri", "lead_post_uri").withColumn("headline", display_headline())
    both = top.drop("external_uri", "text", "author_did").join(seen, "lead_post_uri")
    at = Window.orderBy(F.desc("cluster_score"), "type_rank", "first_rank")  # at most limit + spare rows
    placed = both.withColumn("pos", F.row_number().over(at) - 1).where(F.col("pos") < limit)
    return placed.select(
        "pos", F.col("lead_post_uri").alias("uri"), F.col("cluster_score").alias("score"), "reasons", "cluster_type", "cluster_id", "post_count", "unique_authors", "canonical_url", "external_uri", "text", "author_did", "author_handle",
        F.coalesce("langs", F.array().cast("array<string>")).alias("langs"), "created_at", "web_url", "headline", F.lit("active").alias("cluster_state"),
    )


def display_headline() -> Column:
    """The chosen headline cleaned, or as it is if nothing is left."""
    raw = F.coalesce(F.nullif("display_headline", F.lit("")), "text")
    return F.get(F.transform(F.array(T.clean_headline(raw)), lambda c: F.coalesce(F.nullif(c, F.lit("")), raw)), 0)  # cleaned once


def story_page(members: DataFrame, views: DataFrame) -> DataFrame:
    """The posts of stories that can be shown, with their headline, and whether their text is shown below it."""
    seen = shown(views).select("uri", "display_headline", "text", "author_handle", "web_url", F.col("created_at").alias("shown_at"), "like_count", "reply_count", F.col("external_uri").alias("link"))
    both = members.select("cluster_id", "uri", "author_did", F.col("score_r").alias("score"), (F.col("place") == 1).alias("is_lead")).join(seen, "uri")
    return both.withColumns({"headline": display_headline(), "shows_text": F.length("text") > 40}).drop("display_headline")


def strong(i: DataFrame) -> Column:
    return ((i.post_count >= 3) & (i.unique_authors >= 2)) | is_graph(i.reasons) | (i.score > 6)


def compacted(i: DataFrame) -> DataFrame:
    """Floods of one document family become a card: the best and the strong stay, two or more others go in."""
    link = F.coalesce(F.nullif("external_uri", F.lit("")), "canonical_url")
    f = i.withColumn("family", U.docket_family(link, F.col("reasons"), F.col("author_handle")))
    by = Window.partitionBy("family")
    f = f.withColumn("n", F.count("family").over(by)).withColumn("nth", F.row_number().over(by.orderBy(F.desc("score"), "pos")))
    f = f.withColumn("folds", F.col("family").isNotNull() & (F.col("n") >= dims.DOCKET_LEAST) & (F.col("nth") > 1) & ~strong(f))
    f = f.withColumn("m", F.count_if("folds").over(by)).withColumn("folded", F.col("folds") & (F.col("m") >= 2))
    f = f.withColumn("family_first", F.min("pos").over(by))
    cards = f.where("folded").groupBy("family").agg(
        F.min(F.struct("nth", "uri", "score", "reasons", "external_uri", "created_at", "web_url")).alias("lead"), F.count(F.lit(1)).alias("post_count"), F.countDistinct("author_did").alias("unique_authors"), F.min("family_first").alias("family_first"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("nth", "headline"))), 1, 5), lambda x: F.substring(x["headline"], 1, 80)).alias("preview"),
    )
    titles = F.create_map(*[F.lit(x) for k, (_, t, _) in dims.DOCKETS.items() for x in (k, t)])
    subtitles = F.create_map(*[F.lit(x) for k, (_, _, s) in dims.DOCKETS.items() for x in (k, s)])
    cards = cards.select(
        F.col("lead.uri").alias("uri"), (F.col("lead.score") * 0.8).alias("score"), F.col("lead.reasons").alias("reasons"), F.lit("docket").alias("cluster_type"), F.concat(F.lit("docket_"), "family").alias("cluster_id"), "post_count", "unique_authors",
        F.lit(None).cast("string").alias("canonical_url"), F.col("lead.external_uri").alias("external_uri"), F.lit("").alias("text"), F.lit("").alias("author_did"), F.lit("").alias("author_handle"),
        F.array().cast("array<string>").alias("langs"), F.col("lead.created_at").alias("created_at"), F.col("lead.web_url").alias("web_url"), titles[F.col("family")].alias("headline"), F.lit("active").alias("cluster_state"),
        F.lit(True).alias("is_docket"), "family_first", F.replace(subtitles[F.col("family")], F.lit("{count}"), F.col("post_count").cast("string")).alias("subtitle"), "preview",
    )
    rest = f.where("not folded").select(*[c for c in i.columns if c != "pos"], F.lit(False).alias("is_docket"), F.col("pos").alias("family_first"), F.lit(None).cast("string").alias("subtitle"), F.array().cast("array<string>").alias("preview"))
    every = rest.unionByName(cards)
    return every.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "is_docket", "family_first")) - 1).drop("family_first")


def hero_eligible() -> Column:
    """Enough of a headline, a reason to lead, English if a language is given, and mostly Latin letters."""
    headline = F.coalesce(F.nullif("headline", F.lit("")), "text")
    cleaned = T.clean_headline(headline)
    shape = (F.length(cleaned) >= 20) & (F.length(cleaned) >= F.length(headline) * 0.4) & ~cleaned.startswith("- ")
    worth = F.array_contains("reasons", "original") | F.exists("reasons", lambda r: r.startswith("substance")) | F.exists("reasons", lambda r: r.startswith("domain:"))
    english = (F.size("langs") == 0) | F.array_contains("langs", "en")
    return shape & worth & english & T.mostly_latin(headline)


def hero(i: DataFrame) -> DataFrame:
    return i.agg(F.coalesce(F.min(F.when(hero_eligible(), F.col("pos"))), F.lit(0)).alias("hero_idx"))


def statistics(i: DataFrame) -> DataFrame:
    has = lambda r: F.array_contains("reasons", r)
    kind = F.col("cluster_type")
    s = i.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has("original")).alias("originals"), F.count_if(kind == "url").alias("url_clusters"), F.count_if(kind == "root").alias("root_clusters"), F.count_if(~kind.isin("url", "root")).alias("singletons"),
        F.count_if(is_graph(F.col("reasons"))).alias("graph_count"), F.count_if(has("unknown_author")).alias("outsider_count"), F.count_if("is_docket").alias("docket_count"),
    )
    return s.withColumn("original_pct", F.bround(F.lit(100.0) * F.col("originals") / F.greatest("total", F.lit(1))).cast("long"))


def top_domains(i: DataFrame, k: int = 5) -> DataFrame:
    d = i.withColumn("domain", U.display_domain(F.coalesce(F.nullif("external_uri", F.lit("")), "canonical_url"))).where("domain is not null")
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(k)


def character(i: DataFrame) -> DataFrame:
    """One line on what kind of edition this is."""
    top = top_domains(i, 3).agg(F.coalesce(F.max_by("domain", F.struct("n", -F.col("first_pos"))), F.lit("")).alias("d1"), F.coalesce(F.max("n"), F.lit(0)).alias("n1"), F.coalesce(F.sum("n"), F.lit(0)).alias("n3"), F.count(F.lit(1)).alias("ds"))
    s = statistics(i).crossJoin(top)  # one row each
    c = F.col
    traits = F.array_compact(
        F.array(
            F.when(c("url_clusters") >= c("total") * 0.3, "cluster-heavy"), F.when(c("docket_count") >= 2, "document-heavy"),
            F.when(c("outsider_count") > c("graph_count"), "outsider-led").when(c("graph_count") > c("outsider_count") * 2, "graph-heavy"),
            F.when(c("n1") >= 4, F.concat("d1", F.lit("-dominated"))).when((c("ds") >= 3) & (c("n3") >= c("total") * 0.5), "source-diverse"),
        )
    )
    line = F.when(F.size(traits) > 0, F.array_join(F.slice(traits, 1, 2), ", ")).otherwise(F.when(c("original_pct") >= 90, "high-originality").otherwise("mixed"))
    return s.select(F.when(c("total") == 0, "Empty edition").otherwise(F.concat(F.upper(F.substring(line, 1, 1)), F.lower(F.substring(line, 2, 1000)))).alias("character"))


def columns(i: DataFrame, quota: int = 8, rest: int = 29) -> DataFrame:
    """Front page columns: sources, graph, wire; two row numbers stand for the two quotas."""
    shown = i.crossJoin(hero(i)).where("pos != hero_idx").drop("hero_idx").orderBy("pos").limit(rest)  # one row on the right
    url, outsider = F.col("cluster_type") == "url", F.array_contains("reasons", "unknown_author")
    graph = is_graph(F.col("reasons")) & ~url
    c = shown.withColumn("wants_source", F.col("is_docket") | (~graph & (url | outsider)))
    c = c.withColumn("s", F.when(F.col("wants_source"), F.row_number().over(Window.partitionBy("wants_source").orderBy("pos"))))
    c = c.withColumn("wants_graph", graph & ~(F.col("is_docket") & (F.coalesce("s", F.lit(99)) <= quota)))
    c = c.withColumn("g", F.when(F.col("wants_graph"), F.row_number().over(Window.partitionBy("wants_graph").orderBy("pos"))))
    return c.select("pos", "uri", F.when(F.col("s") <= quota, "source").when(F.col("g") <= quota, "graph").otherwise("wire").alias("col"))


def lens(i: DataFrame, name: str) -> DataFrame:
    """Items of a topic: by their link's domain, or by a keyword anywhere in text and headline."""
    domains, words = dims.LENSES[name]
    d = U.host(F.coalesce(F.nullif("external_uri", F.lit("")), "canonical_url"))
    said = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("headline", F.lit(""))))
    hit = U.within(d, domains) | F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(said, w))
    if name == "business":
        hit |= F.exists("reasons", lambda r: r.startswith("domain:") & F.get(F.split(r, ":"), 1).isin(dims.BUSINESS_REGULATORS))
    return i.where(hit).withColumn("lens_pos", F.row_number().over(Window.orderBy("pos")) - 1)  # an edition's items


STATES = ("emerging", "persistent", "fading")


def tags(reasons: Column, most: int = 4, state: Column | None = None) -> Column:
    """Reader-facing tags (``css, label``) of the reasons, one of each category, in order.

    A story's ``state`` comes first if it is worth a mark, and takes one of the places.
    """
    css = F.create_map(*[F.lit(x) for k, (a, _) in dims.TAGS.items() for x in (k, a)])
    label = F.create_map(*[F.lit(x) for k, (_, b) in dims.TAGS.items() for x in (k, b)])

    def tag(category: Column, kind: Column, text: Column) -> Column:
        return F.struct(category.alias("category"), kind.alias("css"), text.alias("label"))

    def of(r: Column) -> Column:
        parts = F.split(r, ":")
        worth = F.regexp_replace(F.get(parts, 2), r"^\+*", "").try_cast("double")
        kind = F.when(worth >= 2.5, "source").when(worth >= 1, "reporting").otherwise("link")
        domain = tag(F.lit("source"), kind, F.when(worth >= 2.5, "primary source").when(worth >= 1, "reporting").otherwise(F.get(parts, 1)))
        known = css[r].isNotNull()
        return F.when(known, tag(css[r], css[r], label[r])).when(r.startswith("domain:") & (F.size(parts) >= 3), domain).when(r.startswith("substance"), tag(F.lit("substance"), F.lit("substance"), F.lit("substance")))

    made = F.filter(F.transform(reasons, of), lambda t: t.isNotNull())
    kinds = F.transform(made, lambda t: t["category"])
    first = F.filter(F.transform(made, lambda t, k: F.when(F.array_position(kinds, t["category"]) == k + 1, F.struct(t["css"].alias("css"), t["label"].alias("label")))), lambda x: x.isNotNull())
    if state is None:
        return F.slice(first, 1, most)
    mark = F.array(F.struct(F.concat(F.lit("state-"), state).alias("css"), state.alias("label")))
    return F.when(state.isin(*STATES), F.concat(mark, F.slice(first, 1, most - 1))).otherwise(F.slice(first, 1, most))


def difference(current: DataFrame, previous: DataFrame) -> DataFrame:
    new = current.join(previous, "uri", "left_anti").select("uri", F.lit("new").alias("change"))
    return new.union(previous.join(current, "uri", "left_anti").select("uri", F.lit("gone").alias("change")))


def retained(editions: DataFrame, keep: int = dims.EDITIONS_KEPT) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("feed_name").orderBy(F.desc("created_at"), F.desc("edition_id")))
    return editions.withColumn("nth", nth).where(F.col("nth") <= keep)


def frozen(held: DataFrame, page: DataFrame, feed_name: str, edition_id: str, now: datetime) -> DataFrame:
    """The next edition as one row, numbered behind those held of its feed."""
    every = page.agg(F.array_sort(F.collect_list(F.struct("pos", "uri", "headline", F.col("external_uri").alias("link"), "canonical_url"))).alias("items"))  # an edition's items
    number = held.where(F.col("feed_name") == feed_name).agg((F.count(F.lit(1)) + 1).alias("edition_num"))
    domains = top_domains(page).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_pos", "domain"))), lambda x: F.struct(x["domain"].alias("domain"), (-x["n"]).alias("n"))).alias("top_domains"))
    stats = statistics(page).crossJoin(character(page)).crossJoin(number).crossJoin(domains)  # one row each
    one = stats.crossJoin(every).crossJoin(hero(page))
    inner = F.struct("total", "original_pct", "url_clusters", "root_clusters", "singletons", "character", "top_domains", "edition_num")
    return one.select(F.lit(edition_id).alias("edition_id"), F.lit(feed_name).alias("feed_name"), F.lit(now).cast("timestamp_ntz").alias("created_at"), "items", inner.alias("stats"), F.col("hero_idx").cast("int").alias("hero_idx"))


def archive(editions: DataFrame, feed_name: str, most: int = 20) -> DataFrame:
    """The latest editions of a feed, each on one line: number, size, lead and three domains."""
    latest = editions.where(F.col("feed_name") == feed_name).orderBy(F.desc("created_at"), F.desc("edition_id")).limit(most)
    lead = F.get("items", F.col("hero_idx"))["headline"]
    return latest.select(
        "edition_id", "created_at", F.lpad(F.col("stats.edition_num").cast("string"), 4, "0").alias("edition_no"), F.col("stats.total").alias("total"), F.col("stats.original_pct").alias("original_pct"), F.col("stats.url_clusters").alias("url_clusters"),
        F.coalesce(T.truncate(lead, 80), F.lit("")).alias("hero_headline"), F.array_join(F.transform(F.slice("stats.top_domains", 1, 3), lambda d: d["domain"]), ", ").alias("domains"), F.col("stats.character").alias("character"),
    )
