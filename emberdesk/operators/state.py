"""Tables that change: every change is a new frame or a new folder, never a write over what is being read."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` and, of keys it lacks, the first incoming row."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return stored.unionByName(first.join(stored, key, "left_anti").select(*stored.columns))


def delete(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows, and ``columns`` of known rows overwritten; other columns of known rows stay."""
    new = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    both = stored.join(new, key, "full_outer")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def replace_partition(rows: DataFrame, path: str, by: str = "feed_name") -> None:
    """Overwrite only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str, by: str = "feed_name") -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def purge(posts: DataFrame, now: datetime, hours: int = dims.RETENTION_HOURS) -> DataFrame:
    return posts.where(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{hours}' HOUR"))


def nth_latest(editions: DataFrame, n: int) -> DataFrame:
    """The latest (1) or previous (2) edition of each feed."""
    nth = F.row_number().over(Window.partitionBy("feed_name").orderBy(F.desc("created_at"), F.desc("edition_id")))
    return editions.withColumn("nth", nth).where(F.col("nth") == n).drop("nth")


def exclusions(held: DataFrame, commands: DataFrame) -> DataFrame:
    """The table of exclusions after ``commands`` (``did, sent_at, command``): the last one decides.

    Asking out inserts or updates; asking in only updates, so nothing comes of it for someone who never
    asked out. The source stays that of the first request.
    """
    said = commands.groupBy("did").agg(F.max(F.struct("sent_at", "command")).alias("last"), F.min(F.when(F.col("command") == "opt_out", F.col("sent_at"))).alias("out"))
    both = held.join(said, "did", "full_outer").where(F.col("state").isNotNull() | F.col("out").isNotNull())
    state = F.when(F.col("last.command") == "opt_out", "excluded").when(F.col("last.command") == "opt_in", "included").otherwise(F.col("state"))
    return both.select("did", F.coalesce("last.sent_at", "requested_at").alias("requested_at"), F.coalesce("source", F.lit("dm")).alias("source"), state.alias("state"), F.when(F.col("out").isNotNull(), "").otherwise(F.col("note")).alias("note"))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def sampled(rows: DataFrame, kind: str, id_col: str, seed: Column, count: int) -> DataFrame:
    """A repeatable pick with varied kinds: ordered by a digest of seed and id, the first of each kind before others.

    The digest is MD5 of ``seed:id``, which any engine can compute. Of each kind only the first ``count`` can be
    picked, so a kind is ranked within salts first: no task ranks a whole one.
    """
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.col(id_col).cast("string")).cast("binary"))
    keyed = rows.withColumn("__h", digest).withColumn("__s", F.pmod(F.xxhash64("__h"), F.lit(64)))
    for by in ([kind, "__s"], [kind]):
        keyed = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__h", id_col))).where(F.col("__n") <= count)
    return keyed.orderBy(F.col("__n") > 1, "__h", id_col).limit(count).drop("__h", "__n", "__s")


def hour_seed(at: Column) -> Column:
    return F.year(at) * 100000 + F.dayofyear(at) * 100 + F.hour(at)
