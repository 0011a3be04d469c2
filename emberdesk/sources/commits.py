"""Commit events as JSON: the wire schema, flat posts from it, and the inclusion gate."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

WIRE = (
    "kind string, did string, time_us long, commit struct<operation:string, collection:string, rkey:string, cid:string, record:struct<text:string, createdAt:string, langs:array<string>, "
    "reply:struct<parent:struct<uri:string>, root:struct<uri:string>>, embed:struct<`$type`:string, external:struct<uri:string>, media:struct<external:struct<uri:string>>, record:struct<uri:string>>, "
    "facets:array<struct<features:array<struct<`$type`:string>>>>>>"
)
POST, REPOST = "app.bsky.feed.post", "app.bsky.feed.repost"


def frames(posts: DataFrame, *beside: str) -> DataFrame:
    """One create event as a JSON line for each post, and columns ``beside`` it: the inverse of ``parsed`` for tests and streams."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', created_at)")
    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    link, quote, kind = F.struct(F.col("external_uri").alias("uri")), F.struct(F.col("quote_uri").alias("uri")), F.col("event_id") % 3
    # Links stand in the embed itself or in its media; pictures and quotes are embeds of their own type.
    link_type = F.when(kind == 0, "app.bsky.embed.recordWithMedia").otherwise("app.bsky.embed.external")
    with_link = F.struct(link_type.alias("$type"), F.when(kind != 0, link).alias("external"), F.when(kind == 0, F.struct(link.alias("external"))).alias("media"), F.when(F.col("quote_uri").isNotNull(), quote).alias("record"))
    other = F.struct(F.when(F.col("has_image"), "app.bsky.embed.images").otherwise("app.bsky.embed.record").alias("$type"), F.lit(None).cast("struct<uri:string>").alias("external"), F.lit(None).cast("struct<external:struct<uri:string>>").alias("media"), F.when(F.col("quote_uri").isNotNull(), quote).alias("record"))
    embed = F.when(F.col("external_uri").isNotNull(), with_link).when(F.col("has_image") | F.col("quote_uri").isNotNull(), other)
    facets = F.transform(F.sequence(F.lit(1), F.col("facets_count")), lambda k: F.struct(F.array(F.struct(F.when(k <= F.col("link_count"), "app.bsky.richtext.facet#link").otherwise("app.bsky.richtext.facet#tag").alias("$type"))).alias("features")))
    record = F.struct("text", created.alias("createdAt"), F.array("lang").alias("langs"), F.when(F.col("reply_to_uri").isNotNull(), F.struct(F.struct(F.col("reply_to_uri").alias("uri")).alias("parent"), F.struct(F.col("root_uri").alias("uri")).alias("root"))).alias("reply"), embed.alias("embed"), F.when(F.col("facets_count") > 0, facets).alias("facets"))
    commit = F.struct(F.lit("create").alias("operation"), F.when(F.col("is_repost"), REPOST).otherwise(POST).alias("collection"), F.col("event_id").cast("string").alias("rkey"), F.lit("c").alias("cid"), record.alias("record"))
    return posts.select(*beside, F.to_json(F.struct(F.lit("commit").alias("kind"), F.col("author_did").alias("did"), micros.alias("time_us"), commit.alias("commit"))).alias("value"))


def parsed(lines: DataFrame, now: datetime | None = None) -> DataFrame:
    """Flat posts, and deletes as tombstones, from JSON lines; what can't be read or isn't a post is left out."""
    once = F.explode(F.array(F.from_json("value", WIRE))).alias("j")  # conditions stay behind it: each would parse the line again
    js = lines.select(once).where("j.kind = 'commit'").select("j.*", "j.commit.*").select("did", "time_us", "operation", "collection", "rkey", "cid", "record.*", F.col("record").isNotNull().alias("has_record"))
    keep = (F.col("operation") == "delete") | (F.col("operation").isin("create", "update") & F.col("collection").isin(POST, REPOST))
    blank = lambda c: F.nullif(c, F.lit(""))
    repost = F.col("collection") == REPOST
    link = F.coalesce(blank(F.col("embed.external.uri")), blank(F.col("embed.media.external.uri")))
    kind = F.coalesce(F.col("embed").getField("$type"), F.lit(""))
    links = F.size(F.filter(F.flatten(F.transform(F.coalesce("facets", F.array().cast("array<struct<features:array<struct<`$type`:string>>>>")), lambda f: f["features"])), lambda x: x.getField("$type") == "app.bsky.richtext.facet#link"))
    at = F.coalesce(F.try_to_timestamp(F.col("createdAt")), F.timestamp_micros("time_us"), F.lit(now).cast("timestamp"))
    p = js.where(keep).withColumns({"link": F.when(~repost, link), "n_links": links})
    return p.select(
        F.concat(F.lit("at://"), "did", F.lit("/"), "collection", F.lit("/"), "rkey").alias("uri"), F.when(F.col("operation") == "delete", "delete").otherwise("create").alias("op"), F.col("did").alias("author_did"), at.alias("created_at"),
        F.when(repost, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.col("reply.parent.uri").alias("reply_to_uri"), F.col("reply.root.uri").alias("root_uri"), F.col("embed.record.uri").alias("quote_uri"),
        F.col("link").alias("external_uri"), U.host(F.col("link")).alias("external_domain"), F.col("link").isNotNull().alias("has_external_embed"), kind.contains("image").alias("has_image"), kind.contains("video").alias("has_video"), repost.alias("is_repost"),
        F.array_join("langs", ",").alias("langs"), F.when(F.col("link").isNotNull() & (F.col("n_links") == 0), 1).otherwise(F.col("n_links")).cast("long").alias("link_count"), F.coalesce(F.size("facets"), F.lit(0)).cast("long").alias("facets_count"),
    )


def gated(posts: DataFrame, graph: DataFrame) -> DataFrame:
    """Deletes, posts of authors in the graph, and posts that link to a domain worth two points or more."""
    seeds = graph.select("author_did", F.lit(True).alias("in_graph")).distinct()
    return posts.join(seeds, "author_did", "left").where((F.col("op") == "delete") | F.col("in_graph") | (U.bonus(F.col("external_domain")) >= 2.0)).drop("in_graph")
