"""What the pages show: previews of changes, column slices, authors of a story, house posts, messages."""

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def utc(value: Column, now: datetime | None = None) -> Column:
    """A time from ISO text, with or without an offset; what can't be read counts as now (without one, null)."""
    return F.coalesce(F.try_to_timestamp(value), F.lit(now).cast("timestamp"))


def change_previews(current: DataFrame, previous: DataFrame, new: int = 5, fading: int = 3, cut: int = 60) -> DataFrame:
    """The first new and fading items by position, with short headlines, and how many there are of each.

    All that came or went count, those without a headline as well; a change that nothing underwent has one row.
    """

    def of(left: DataFrame, right: DataFrame, change: str, most: int) -> DataFrame:
        moved = left.join(right.select("uri"), "uri", "left_anti")
        total = moved.agg(F.countDistinct("uri").alias("total"))  # one row
        first = moved.where("headline <> ''").orderBy("pos", "uri").limit(most)
        short = first.select("uri", T.truncate(F.col("headline"), cut).alias("headline"))
        return total.join(short, F.lit(True), "left").select(F.lit(change).alias("change"), "uri", "headline", "total")

    return of(current, previous, "new", new).union(of(previous, current, "fading", fading))


def wire_slices(wire: DataFrame) -> DataFrame:
    """Places on the wire: the first five in the strip, from the seventh on below the fold in two columns; the sixth isn't shown."""
    i = wire.withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1)  # a front page: 29 items at most
    return i.withColumn("slice", F.when(F.col("i") < 5, "strip").when(F.col("i") >= 6, "fold")).withColumn("side", F.when(F.col("slice") == "fold", (F.col("i") - 6) % 2))


def story_authors(members: DataFrame) -> DataFrame:
    """Each story's authors, once each, in the order of its members."""
    first = members.groupBy("cluster_id", "author_did").agg(F.min("place").alias("place"))
    return first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "author_did"))), lambda x: x["author_did"]).alias("authors"))


def house_posts(posts: DataFrame, authors: list[str], least: int = 20, limit: int = 10) -> DataFrame:
    own = posts.where(F.col("author_did").isin(authors) & (F.length(T.strip(F.col("text"))) >= least) & ~F.col("is_repost"))
    return own.orderBy(F.desc("created_at"), "uri").limit(limit)


def desk_sides(posts: DataFrame, main: str) -> DataFrame:
    """House posts in two columns: one author's, and the others'."""
    return posts.withColumn("side", F.when(F.col("author_did") == main, "main").otherwise("other"))


def watched(posts: DataFrame, authors: list[str], each: int = 5) -> DataFrame:
    """The newest posts of each watched author, in the list's order."""
    own = posts.where(F.col("author_did").isin(authors) & (F.length(T.strip(F.col("text"))) >= 10) & ~F.col("is_repost"))
    nth = F.row_number().over(Window.partitionBy("author_did").orderBy(F.desc("created_at"), "uri"))
    return own.withColumns({"nth": nth, "place": F.array_position(F.array(*[F.lit(a) for a in authors]), F.col("author_did"))}).where(F.col("nth") <= each)


def new_messages(messages: DataFrame, high_water: int) -> DataFrame:
    return messages.where(F.col("sent_at") > high_water)


def high_water(messages: DataFrame, before: int) -> DataFrame:
    return messages.agg(F.greatest(F.coalesce(F.max("sent_at"), F.lit(before)), F.lit(before)).alias("high_water"))


def debug_ranking(composed: DataFrame, most: int = 30) -> DataFrame:
    """The first places of a rank pass as an operator reads them."""
    none = F.lit("")
    return composed.where(F.col("rank") <= most).select(
        "uri", F.col("score_r").alias("score"), F.coalesce("handle", F.lit("?")).alias("author_handle"), F.coalesce("seed_class", none).alias("seed_class"), F.round(F.coalesce("stink_score", F.lit(0.0)), 3).alias("author_stink"),
        F.col("stripped_len").alias("non_url_text_len"), F.coalesce("external_domain", none).alias("external_domain"), F.substring("text", 1, 80).alias("text_preview"),
    )


def debug_stats(posts: DataFrame, authors: DataFrame, exclusions: DataFrame, ranked: DataFrame, editions: DataFrame, state: DataFrame, feed: str, refresh_key: str) -> DataFrame:
    """One row about all tables: their sizes, the latest edition of ``feed``, and the stored value of ``refresh_key``."""
    n = F.count(F.lit(1))
    parts = [
        posts.agg(n.alias("posts")), authors.agg(n.alias("authors"), F.count_if(F.col("seed_class") == "stale").alias("authors_stale")), exclusions.where("state = 'excluded'").agg(n.alias("exclusions")), ranked.agg(n.alias("ranked")),
        editions.agg(n.alias("editions")), editions.where(F.col("feed_name") == feed).agg(F.max_by("edition_id", F.struct("created_at", "edition_id")).alias("latest_edition")),
        state.where(F.col("key") == refresh_key).agg(F.max("value").alias("last_graph_refresh")),
    ]
    return functools.reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
