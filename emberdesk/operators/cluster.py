"""Stories: posts grouped by link, thread or headline, scored, and followed from edition to edition."""

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import dims
from ..functions import text as T
from ..functions import url as U

TYPES = ["url", "root", "headline", "singleton"]


def is_graph(reasons):
    return F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in dims.GRAPH_REASONS]))


def members(ranked: DataFrame) -> DataFrame:
    """Each post with the one story it belongs to: three windows, each over what the last left."""
    c = F.col
    domain = c("external_domain")
    real = domain.isNotNull() & ~U.is_platform(domain)
    m = ranked.withColumns(
        {
            "canonical_url": F.when(c("external_uri").isNotNull() & ~U.is_platform(domain), F.nullif(U.canonical(c("external_uri")), F.lit(""))),
            "thread": F.coalesce("root_uri", "quote_uri"),
            "headline": F.when(real & (F.length("text") >= 30), T.title_key(U.title_family(domain), c("text"))),
        }
    )
    m = m.withColumn("url_n", F.count("canonical_url").over(Window.partitionBy("canonical_url")))
    m = m.withColumn("t1", F.when(c("url_n") < 2, c("thread"))).withColumn("root_n", F.count("t1").over(Window.partitionBy("t1")))
    m = m.withColumn("h1", F.when((c("url_n") < 2) & (c("root_n") < 2), c("headline"))).withColumn("headline_n", F.count("h1").over(Window.partitionBy("h1")))
    kind = F.when(c("url_n") >= 2, "url").when(c("root_n") >= 2, "root").when(c("headline_n") >= 2, "headline").otherwise("singleton")
    m = m.withColumn("cluster_type", kind)
    key = F.when(kind == "url", c("canonical_url")).when(kind == "root", c("thread")).when(kind == "headline", c("headline")).otherwise(c("uri"))
    m = m.withColumn("cluster_key", key).withColumn("cluster_id", F.concat("cluster_type", F.lit("_"), U.key16("cluster_key")))
    m = m.withColumn("graph_tier", F.when(is_graph(c("reasons")), 2).otherwise(0)).withColumn("commentary_tier", F.when(F.length(T.strip_urls(c("text"))) > 60, 1).otherwise(0))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("graph_tier"), F.desc("commentary_tier"), F.desc("score_r"), "rank")
    return m.withColumn("place", F.row_number().over(order))


def clusters(m: DataFrame) -> DataFrame:
    lead = F.struct("place", "uri", "score_r", "reasons", "external_domain", "canonical_url", "thread", "external_uri", "text", "author_did")
    g = m.groupBy("cluster_id", "cluster_type").agg(
        F.count(F.lit(1)).alias("post_count"), F.countDistinct("author_did").alias("unique_authors"), F.min(lead).alias("lead"), F.min(F.struct("rank", "external_domain")).alias("first"),
        F.count_if((F.col("place") > 1) & F.array_contains("reasons", "unknown_author")).alias("outsiders"), F.min("rank").alias("first_rank"), F.first("cluster_key").alias("cluster_key"),
    )
    n, a = F.col("post_count"), F.col("unique_authors")
    url = F.col("cluster_type") == "url"
    domain = F.when(url, U.host(F.col("lead.canonical_url"))).when(F.col("cluster_type") == "headline", F.col("first.external_domain")).otherwise(F.coalesce("lead.external_domain", F.lit("")))
    corroboration = F.when(n == 1, 0.0).when(n <= 3, n * 1.5).otherwise(4.5 + F.log(n - 2) * 0.5)
    diversity = F.when(a <= 1, 0.0).otherwise(F.least(a * F.lit(0.8), F.lit(3.0)))
    penalty = F.when((n >= 3) & (a == 1), 3.0).when((n >= 2) & (a == 1), 1.5).otherwise(0.0)
    g = g.withColumn("domain", domain).withColumn("bonus", U.bonus(F.col("domain")))
    score = F.col("lead.score_r") * 0.45 + corroboration * 0.15 + diversity * 0.10 + F.col("bonus") * 0.10 - penalty
    why = F.when(n == 1, "singleton").when(~is_graph(F.col("lead.reasons")), "best representative by score").when(F.col("outsiders") > 0, F.concat(F.lit("graph member chosen over "), F.col("outsiders").cast("string"), F.lit(" outsider(s)"))).otherwise("graph member with best commentary")
    kinds = F.array(*[F.lit(t) for t in TYPES])
    return g.select(
        "cluster_id", "cluster_type", F.when(url, F.col("lead.canonical_url")).alias("canonical_url"), F.when(F.col("cluster_type") == "root", F.col("lead.thread")).alias("root_uri"), "domain", "post_count", "unique_authors",
        F.col("lead.uri").alias("lead_post_uri"), F.col("lead.score_r").alias("lead_score"), F.round(score, 6).alias("cluster_score"), why.alias("lead_reason"), F.col("lead.reasons").alias("reasons"),
        F.col("lead.external_uri").alias("external_uri"), F.col("lead.text").alias("text"), F.col("lead.author_did").alias("author_did"), "cluster_key", "first_rank", F.array_position(kinds, F.col("cluster_type")).alias("type_rank"),
    )


def lifecycle(stored: DataFrame, current: DataFrame) -> DataFrame:
    """New stories emerge, seen again they are active, from three editions on persistent; absent ones fade."""
    old = stored.select("cluster_id", F.col("editions_present").alias("was"), F.col("state").alias("old_state"))
    both = old.join(current.select("cluster_id", F.lit(True).alias("here")), "cluster_id", "full_outer")
    seen = F.coalesce("was", F.lit(0)) + F.when(F.col("here"), 1).otherwise(0)
    state = F.when(F.col("here") & F.col("was").isNull(), "emerging").when(F.col("here") & (seen >= 3), "persistent").when(F.col("here"), "active").otherwise("fading")
    return both.select("cluster_id", seen.cast("long").alias("editions_present"), state.alias("state"))


STORY_TABLE = "cluster_id string, cluster_type string, cluster_key string, canonical_url string, root_uri string, domain string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, state string, lead_post_uri string, lead_score double, cluster_score double, post_count long, unique_authors long, editions_present long"
#: What a story that is seen again takes from the edition; the rest stays as it was first written.
REFRESHED = ["lead_post_uri", "lead_score", "cluster_score", "post_count", "unique_authors"]
FIRST_WRITE = ["cluster_type", "cluster_key", "canonical_url", "root_uri", "domain"]


def persisted(stories: DataFrame, current: DataFrame, now: datetime) -> DataFrame:
    """The table of stories after an edition: new ones inserted, seen ones refreshed, live ones that are absent fade."""
    at = F.lit(now).cast("timestamp_ntz")
    new = current.select("cluster_id", *[F.col(c).alias(f"new_{c}") for c in [*FIRST_WRITE, *REFRESHED]], F.lit(True).alias("here"))
    both = stories.join(new, "cluster_id", "full_outer")
    here, known = F.coalesce("here", F.lit(False)), F.col("first_seen_at").isNotNull()
    fades = ~here & F.col("state").isin("active", "emerging", "persistent")
    seen = F.coalesce("editions_present", F.lit(0)) + F.when(here, 1).otherwise(0)
    state = F.when(here & ~known, "emerging").when(here & (seen >= 3), "persistent").when(here, "active").when(fades, "fading").otherwise(F.col("state"))
    out = {
        **{c: F.when(known, F.col(c)).otherwise(F.col(f"new_{c}")) for c in FIRST_WRITE}, **{c: F.when(here, F.col(f"new_{c}")).otherwise(F.col(c)) for c in REFRESHED},
        "first_seen_at": F.coalesce("first_seen_at", at), "last_seen_at": F.when(here | fades, at).otherwise(F.col("last_seen_at")), "state": state, "editions_present": seen,
    }
    schema = T_.StructType.fromDDL(STORY_TABLE)
    return both.select("cluster_id", *[out[f.name].cast(f.dataType).alias(f.name) for f in schema.fields[1:]])


def member_table(held: DataFrame, members_: DataFrame, now: datetime) -> DataFrame:
    """The table of stories' posts after an edition: a post that is there already is replaced."""
    new = members_.select("cluster_id", F.col("uri").alias("post_uri"), "author_did", F.col("score_r").alias("post_score"), F.lit(now).cast("timestamp_ntz").alias("joined_at"), (F.col("place") == 1).alias("is_lead"))
    return held.join(new.select("cluster_id", "post_uri"), ["cluster_id", "post_uri"], "left_anti").unionByName(new)
