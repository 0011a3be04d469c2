"""Display data of posts: embeds by type, headline choice, visibility."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

EXTERNAL = "struct<uri:string, title:string, description:string>"
INNER = f"struct<`$type`:string, external:{EXTERNAL}, media:struct<`$type`:string, external:{EXTERNAL}>>"
VIEW = (
    "uri string, author struct<did:string, handle:string, displayName:string, labels:array<struct<val:string>>>, record struct<text:string, createdAt:string, langs:array<string>>, "
    f"embed struct<`$type`:string, external:{EXTERNAL}, media:struct<`$type`:string, external:{EXTERNAL}>, record:struct<embeds:array<{INNER}>>>, likeCount long, replyCount long, repostCount long"
)
LINK, WITH_MEDIA, QUOTE = "app.bsky.embed.external#view", "app.bsky.embed.recordWithMedia#view", "app.bsky.embed.record#view"


def _direct(e: Column) -> Column:
    kind = e.getField("$type")
    return F.when(kind == LINK, e["external"]).when((kind == WITH_MEDIA) & (e["media"].getField("$type") == LINK), e["media"]["external"])


def embed_link(e: Column) -> Column:
    """The link of an embed; of a quoted record the first of its embeds that has one (one level)."""
    quoted = F.get(F.filter(F.transform(e["record"]["embeds"], _direct), lambda x: x["uri"].isNotNull()), 0)
    return F.coalesce(_direct(e), F.when(e.getField("$type") == QUOTE, quoted))


def media_kind(e: Column) -> Column:
    kind, media = F.coalesce(e.getField("$type"), F.lit("")), F.coalesce(e["media"].getField("$type"), F.lit(""))
    return F.when(kind.contains("images") | ((kind == WITH_MEDIA) & media.contains("images")), "image").when(kind.contains("video"), "video")


def headline(text: Column, title: Column, trimmed: Column | None = None) -> Column:
    """The embed's title where it says more than the text; ``trimmed`` is the text without white space around it."""
    t = T.strip(text) if trimmed is None else trimmed
    linkish = t.contains("http") | t.contains("www.") | t.contains(".com/") | t.contains(".org/")
    opens = [t.startswith(x) for x in ("- ", '"...', "“...", "...", "♫", "♪", "http", "www.")]
    stub = (F.length(t) < 60) | opens[0] | opens[1] | opens[2] | opens[3] | opens[4] | opens[5] | opens[6] | opens[7] | (linkish & (F.length(t) < 140))
    return F.when((F.length(T.strip(title)) >= 10) & (stub | (F.length(title) > F.length(t))), title).otherwise(text)


def shown(views: DataFrame) -> DataFrame:
    """Flat views of posts that readers without an account may see."""
    e = F.col("embed")
    v = views.where(~F.exists(F.coalesce("author.labels", F.array().cast("array<struct<val:string>>")), lambda x: x["val"] == "!no-unauthenticated"))
    v = v.withColumn("link", embed_link(e)).withColumn("text", F.coalesce("record.text", F.lit("")))
    v = v.withColumn("trimmed", T.strip(F.col("text")))  # read many times
    return v.select(
        "uri", U.web_url(F.col("uri")).alias("web_url"), F.col("author.did").alias("author_did"), F.col("author.handle").alias("author_handle"), F.coalesce("author.displayName", "author.handle").alias("author_display_name"), "text",
        headline(F.col("text"), F.col("link.title"), F.col("trimmed")).alias("display_headline"), F.col("record.createdAt").alias("created_at"), F.col("link.uri").alias("external_uri"), F.col("link.title").alias("external_title"), media_kind(e).alias("media_type"),
        F.coalesce("likeCount", F.lit(0)).alias("like_count"), F.coalesce("replyCount", F.lit(0)).alias("reply_count"), F.coalesce("repostCount", F.lit(0)).alias("repost_count"), F.col("record.langs").alias("langs"),
    )
