"""Trailing windows kept as they go: hourly partial sums by author and domain, merged to any trailing span.

A batch of posts adds rows to the partial sums; nothing older is touched. A span's whole hours come from the sums,
and only its first hour, which the span may begin within, from posts. Counts at each post are running counts inside
an author's hour and between hours, so no task holds more than one hour of one author.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from . import rank

SUMS = ["n", "links", "titles", "talk", "bare"]
SCHEMA = "author_did string, external_domain string, hour timestamp_ntz, n long, links long, titles long, talk long, bare long"


def _hour(c: str) -> F.Column:
    return F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")


def hourly(posts: DataFrame) -> DataFrame:
    """Partial sums by author, domain and hour: rows to append, whatever was appended before."""
    link, bare = F.col("has_external_embed"), F.length(T.strip_urls(F.col("text")))
    rows = posts.select("author_did", "external_domain", _hour("created_at").alias("hour"), link.alias("link"), bare.alias("bare"), (F.col("reply_to_uri").isNotNull().cast("long") + F.col("quote_uri").isNotNull().cast("long")).alias("talk"))
    return rows.groupBy("author_did", "external_domain", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("link").alias("links"), F.count_if(F.col("link") & (F.col("bare") < 30)).alias("titles"), F.sum("talk").cast("long").alias("talk"), F.sum("bare").cast("long").alias("bare")
    )


def span(partials: DataFrame, posts: DataFrame, now: datetime, hours: int) -> DataFrame:
    """Sums by author and domain over the last ``hours`` up to ``now``: whole hours from the partial sums, the hours at both ends from posts."""
    first, last = now - timedelta(hours=hours), now
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    whole = partials.where((F.col("hour") > at(first)) & (F.col("hour") < at(floor(last))))
    ends = posts.where(F.col("created_at").between(at(first), at(last)))
    inner = floor(first) + timedelta(hours=1) if floor(first) != first else first + timedelta(hours=1)
    ends = ends.where((F.col("created_at") < at(inner)) | (F.col("created_at") >= at(floor(last))))
    both = whole.select("author_did", "external_domain", *SUMS).unionByName(hourly(ends).select("author_did", "external_domain", *SUMS))
    return both.groupBy("author_did", "external_domain").agg(*[F.sum(c).alias(c) for c in SUMS])


def profiles(partials: DataFrame, posts: DataFrame, now: datetime) -> DataFrame:
    """``rank.profiles`` from partial sums: the last seven days at any time ``now``."""
    return rank.profiles_of(span(partials, posts, now, dims.PROFILE_DAYS * 24))


def post_counts(partials: DataFrame, posts: DataFrame, now: datetime) -> DataFrame:
    """``rank.post_counts`` from partial sums: the last 24 hours at any time ``now``."""
    return span(partials, posts, now, dims.HORIZON_HOURS).groupBy("author_did").agg(F.sum("n").alias("posts_24h"))


def running_counts(posts: DataFrame, spans: dict[str, int]) -> DataFrame:
    """``uri`` and, for each name of ``spans``, how many posts its author wrote in so many hours up to it, itself and those of its moment included.

    What a RANGE window over an author would count, without such a window: an hour's posts are counted within the
    hour; those that left the span since come back as events shifted by it; whole hours between come from their totals.
    """
    base = posts.select("uri", "author_did", "created_at", _hour("created_at").alias("hour"))
    by_hour = base.groupBy("author_did", "hour").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', hour)"))
    totals = by_hour
    for name, hours in spans.items():
        before = Window.partitionBy("author_did").orderBy("h").rangeBetween(-hours, -1)  # an author's hours, not its posts
        totals = totals.withColumn(f"{name}__whole", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = base.join(totals.drop("n", "h"), ["author_did", "hour"])
    cell = Window.partitionBy("author_did", "hour").orderBy("created_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("own", F.count(F.lit(1)).over(cell))
    for name, hours in spans.items():
        shift = F.expr(f"INTERVAL '{hours}' HOUR")
        left = base.select(F.lit(None).cast("string").alias("uri"), "author_did", (F.col("created_at") + shift).alias("created_at"), (F.col("hour") + shift).alias("hour"), F.lit(1).alias("left"))
        both = out.withColumn("left", F.lit(0)).unionByName(left, allowMissingColumns=True)
        # Posts exactly as old as the span still count: those that left before this moment.
        ended = Window.partitionBy("author_did", "hour").orderBy("created_at", F.desc("left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy("author_did", "hour", "created_at")
        both = both.withColumn("gone", F.sum("left").over(ended) - F.sum("left").over(same)).where("left = 0")
        out = both.withColumn(name, (F.col(f"{name}__whole") + F.col("own") - F.col("gone")).cast("long")).drop("left", "gone", f"{name}__whole")
    return out.select("uri", *spans)
