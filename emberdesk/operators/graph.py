"""The trust graph: two edge sets become classes; authors that left are demoted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classified(follows: DataFrame, followers: DataFrame) -> DataFrame:
    a = follows.select("did", F.lit(True).alias("out"))
    b = followers.select("did", F.lit(True).alias("back"))
    kind = F.when(F.col("out") & F.col("back"), "mutual").when(F.col("out"), "followed").otherwise("follower")
    trust = F.when(kind == "mutual", 4.0).when(kind == "followed", 2.0).otherwise(1.0)
    return a.join(b, "did", "full_outer").select("did", kind.alias("seed_class"), trust.alias("trusted_score"))


def refreshed(authors: DataFrame, follows: DataFrame, followers: DataFrame) -> DataFrame:
    """Upsert of the current graph; authors outside it become stale."""
    now = classified(follows, followers).select(F.col("did").alias("author_did"), F.col("seed_class").alias("new_class"), F.col("trusted_score").alias("new_trust"))
    both = authors.join(now, "author_did", "full_outer")
    return both.select("author_did", F.coalesce("new_class", F.lit("stale")).alias("seed_class"), F.coalesce("new_trust", F.when(F.col("seed_class") == "stale", F.col("trusted_score")).otherwise(0.1)).alias("trusted_score"))


def counters(authors: DataFrame, follows: DataFrame, followers: DataFrame) -> DataFrame:
    """One row about a refresh: the graph's size, mutual follows, both edge sets, and known authors outside the graph."""
    now = classified(follows, followers)
    sizes = now.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("seed_class") == "mutual").alias("mutuals"), F.count_if(F.col("seed_class") != "follower").alias("follows"), F.count_if(F.col("seed_class") != "followed").alias("followers"))
    gone = authors.select(F.col("author_did").alias("did")).distinct().join(now, "did", "left_anti").agg(F.count(F.lit(1)).alias("stale"))
    return sizes.crossJoin(gone)  # one row each
