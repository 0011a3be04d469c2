"""Candidates, author profiles, scores, composition caps and feed pages."""

import json
from collections import Counter
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import score as S
from ..functions import text as T
from ..functions import url as U
from ..shared import stored


def since(posts: DataFrame, now: datetime, hours: int) -> DataFrame:
    """Posts of the last ``hours``; the bound is a literal, so it reaches the scan."""
    return posts.where(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{hours}' HOUR"))


def post_counts(posts: DataFrame, now: datetime) -> DataFrame:
    return since(posts, now, dims.HORIZON_HOURS).groupBy("author_did").agg(F.count(F.lit(1)).alias("posts_24h"))


def profiles(posts: DataFrame, now: datetime) -> DataFrame:
    """How relay-shaped each author's last seven days are; authors with three posts at least.

    Two levels of one aggregation: by author and domain, then by author.
    """
    recent = S.measured(since(posts, now, dims.PROFILE_DAYS * 24)).withColumnRenamed("stripped_len", "bare")
    link = F.col("has_external_embed")
    by_domain = recent.groupBy("author_did", "external_domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(link).alias("links"), F.count_if(link & (F.col("bare") < 30)).alias("titles"),
        (F.count("reply_to_uri") + F.count("quote_uri")).alias("talk"), F.sum("bare").alias("bare"),
    )
    return profiles_of(by_domain)


def profiles_of(by_domain: DataFrame) -> DataFrame:
    """Profiles from sums by author and domain (``n, links, titles, talk, bare``)."""
    named = F.col("external_domain").isNotNull()
    a = by_domain.groupBy("author_did").agg(
        F.sum("n").alias("total"), F.sum("links").alias("links"), F.sum("titles").alias("titles"), F.sum("talk").alias("talk"), F.sum("bare").alias("bare"),
        F.max(F.when(named, F.col("n"))).alias("top"), F.sum(F.when(named, F.col("n"))).alias("named"),
    ).where("total >= 3")
    link_ratio, reply_ratio, mean = F.col("links") / F.col("total"), F.col("talk") / F.col("total"), F.col("bare") / F.col("total")
    titles = F.when(F.col("links") > 0, F.col("titles") / F.col("links")).otherwise(0.0)
    concentration = F.coalesce(F.col("top") / F.col("named"), F.lit(0.0))
    stink = link_ratio * 0.30 + titles * 0.25 + concentration * 0.15 + (1 - F.least(reply_ratio / 0.20, F.lit(1.0))) * 0.15 + (1 - F.least(mean / 120.0, F.lit(1.0))) * 0.15
    return a.select("author_did", "total", link_ratio.alias("link_post_ratio"), reply_ratio.alias("reply_ratio"), mean.alias("avg_non_url_len"), concentration.alias("domain_concentration"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), stink)).alias("stink_score"))


def excluded(commands: DataFrame) -> DataFrame:
    """Authors whose last command asked to be left out."""
    return last_commands(commands).where("last_command = 'opt_out'").select("did")


def last_commands(commands: DataFrame) -> DataFrame:
    """``did, last_command``: what each author asked last; messages without a command say nothing."""
    said = commands.withColumn("command", T.command(F.col("text"))).where("command is not null")
    return said.groupBy("did").agg(F.max_by("command", "sent_at").alias("last_command"))


def candidates(posts: DataFrame, commands: DataFrame, now: datetime) -> DataFrame:
    """Posts of the horizon whose authors didn't ask to be left out."""
    return since(posts, now, dims.HORIZON_HOURS).join(excluded(commands), F.col("author_did") == F.col("did"), "left_anti")


def relays(posts: DataFrame) -> DataFrame:
    """How often each author linked to each domain."""
    return posts.where("external_domain is not null").groupBy("author_did", "external_domain").agg(F.count(F.lit(1)).alias("outsider_posts"))


def outsider_relays(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """``relays`` of authors outside the graph."""
    return relays(posts.join(authors, "author_did", "left_anti"))


def author_table(authors: DataFrame, posts: DataFrame, now: datetime) -> DataFrame:
    known = authors.join(post_counts(posts, now), "author_did", "left").join(profiles(posts, now), "author_did", "left")
    return known.withColumns({"posts_24h": F.coalesce("posts_24h", F.lit(0)), "stink_score": F.coalesce("stink_score", F.lit(0.0)), "link_post_ratio": F.coalesce("link_post_ratio", F.lit(0.0)), "reply_ratio": F.coalesce("reply_ratio", F.lit(0.0))})


def score_posts(posts: DataFrame, authors: DataFrame, commands: DataFrame, now: datetime) -> DataFrame:
    """Every candidate of the horizon with its components, score and reasons."""
    about = author_table(authors, posts, now).select("author_did", "handle", "seed_class", "trusted_score", "posts_24h", "stink_score", F.lit(True).alias("is_known"))
    joined = candidates(posts, commands, now).join(about, "author_did", "left").join(relays(posts), ["author_did", "external_domain"], "left")
    age = F.expr("timestampdiff(MICROSECOND, created_at, as_of)") / 3.6e9
    filled = joined.withColumns({"is_known": F.coalesce("is_known", F.lit(False)), "outsider_posts": F.coalesce("outsider_posts", F.lit(0)), "as_of": F.lit(now).cast("timestamp_ntz")})
    return S.scored(filled.withColumn("age_hours", age))


def order() -> tuple:
    return F.desc("score_r"), F.desc("created_at"), F.asc("uri")


def ranked(scored: DataFrame) -> DataFrame:
    """Scores rounded to six places decide; ties go to the newer post, then by uri."""
    return scored.withColumn("score_r", F.round("score", 6))


def pruned(ranked_: DataFrame, per_author: int, per_thread: int, per_link: int) -> DataFrame:
    """Without posts that no caps can let in: of those alike in author, thread and link, only the best few can be.

    Caps only fill up, so a post is turned down if one like it was before.
    """
    alike = ["author_did", "root", "link"]
    keyed = ranked_.withColumns({"root": F.coalesce("root_uri", "uri"), "link": F.coalesce("external_uri", F.lit(""))})
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy(*order()))
    most = F.when(F.col("link") == "", min(per_author, per_thread)).otherwise(min(per_author, per_thread, per_link))
    return keyed.withColumn("alike", nth).where(F.col("alike") <= most).drop("alike")


KEPT = "array<struct<s:double,t:bigint,uri:string,author_did:string,root:string,link:string>>"


def folded(best: DataFrame, kept: list, size: int, per_author: int, per_thread: int, per_link: int) -> DataFrame:
    """One row: the kept posts so far and of ``best``, and the last one that was looked at."""

    def step(acc, x):
        ok = (F.size(acc) < size) & (F.size(F.filter(acc, lambda k: k["author_did"] == x["author_did"])) < per_author) & (F.size(F.filter(acc, lambda k: k["root"] == x["root"])) < per_thread)
        ok &= (x["link"] == "") | (F.size(F.filter(acc, lambda k: k["link"] == x["link"])) < per_link)
        return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

    before = F.from_json(F.lit(json.dumps([k.asDict() for k in kept])), KEPT)
    xs = best.agg(F.array_sort(F.collect_list(F.struct("s", "t", "uri", "author_did", "root", "link"))).cast(KEPT).alias("xs"))
    return xs.select(F.aggregate("xs", before, step).alias("kept"), F.size("xs").alias("seen"), F.element_at("xs", F.when(F.size("xs") > 0, -1)).alias("last"))


def composed(scored: DataFrame, size: int = dims.PAGE_SIZE * dims.BUFFER_PAGES, per_author: int = dims.PER_AUTHOR, per_thread: int = dims.PER_THREAD, per_link: int = dims.PER_LINK, block: int = 2_000) -> DataFrame:
    """The best posts under caps for each author, thread and link, ranked.

    A rejected post takes nothing from the other caps, so this is a fold, not a window. Posts are scored
    once and stored without those that can't get in. The fold reads the best ``block`` of them, found behind
    a score that about as many reach, so that tasks don't each send a block to the one that folds; should more
    be needed, the next block leaves out the posts of every author, thread and link whose cap is full, so
    its first post is kept: rounds are bounded by ``size``, a task by ``block``, the driver by ``size``.
    """
    rows = stored(pruned(ranked(scored), per_author, per_thread, per_link).withColumns({"s": -F.col("score_r"), "t": F.expr("-timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', created_at)")}), "candidates")
    spark, kept, last, todo = rows.sparkSession, [], None, rows
    while True:
        n = todo.count()
        best = todo if n <= block else todo.where(F.col("s") <= todo.approxQuantile("s", [min(1.0, 1.5 * block / n)], 0.2 * block / n)[0])
        got = folded(best.orderBy("s", "t", "uri").limit(block), kept, size, per_author, per_thread, per_link).collect()[0]  # one row of ``size`` posts at most
        kept, last = got.kept, got.last
        if len(kept) >= size or n <= block:
            break
        todo = rows.where(F.struct("s", "t", "uri") > F.struct(F.lit(float(last.s)), F.lit(last.t).cast("bigint"), F.lit(last.uri)))
        for key, most in (("author_did", per_author), ("root", per_thread), ("link", per_link)):
            full = [k for k, n in Counter(x[key] for x in kept).items() if n >= most and (k or key != "link")]
            todo = todo.where(~F.col(key).isin(full)) if full else todo  # fewer than ``size``
    picked = spark.createDataFrame([(k.uri, i + 1) for i, k in enumerate(kept)], "uri string, rank int")
    return F.broadcast(picked).join(rows.drop("s", "t", "root", "link"), "uri")  # at most ``size`` rows


def deduplicated(composed_: DataFrame, limit: int) -> DataFrame:
    """One post for each canonical link, then two for each document family, in rank order."""
    d = composed_.withColumn("canonical", F.when(F.col("external_uri").isNotNull() & ~U.is_platform(F.col("external_domain")), F.nullif(U.canonical(F.col("external_uri")), F.lit(""))))
    d = d.withColumn("family", U.docket_family(F.col("external_uri"), F.col("reasons"), F.lit("")))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy(F.coalesce("canonical", "uri")).orderBy("rank"))).where("canonical is null or nth <= 1")
    d = d.withColumn("fth", F.row_number().over(Window.partitionBy(F.coalesce("family", "uri")).orderBy("rank"))).where(f"family is null or fth <= {dims.PER_FAMILY}")
    return d.orderBy("rank").limit(limit)


def stored_pass(composed_: DataFrame) -> DataFrame:
    """What a rank pass stores for pages: whole posts would be more than a page needs."""
    return composed_.select("rank", "uri", "author_did", "score_r", "external_uri", "external_domain", "reasons").coalesce(1)  # as many rows as the buffer holds


def feed_page(composed_: DataFrame, limit: int = 30, cursor: float | None = None) -> DataFrame:
    """A page behind a score; ``next_cursor`` is the last score of a full page."""
    behind = composed_ if cursor is None else composed_.where(F.col("score_r") < cursor)
    page = deduplicated(behind.orderBy("rank").limit(limit * 2), limit)
    every = Window.partitionBy(F.lit(1))
    return page.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(every) >= limit, F.min("score_r").over(every)))
