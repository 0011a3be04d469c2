"""The engine's front: one object for a session, a time and the input frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from . import schema
from .operators import cluster, edition, graph, rank, state
from .shared import stored
from .tables import Keyed, Snapshots

FEEDS = ("ranked", "edition")


class Engine:
    """Feeds, editions and reports over ``posts``, ``authors``, exclusion ``commands`` and post ``views``.

    Everything is computed as of ``now``; nothing reads the clock. With ``store``, a folder, passes are kept there:
    a rank pass stores the buffer that pages are served from, an edition pass the page, the frozen row and the
    table of stories; pages then read what the last pass stored instead of ranking again.
    """

    def __init__(self, spark: SparkSession, now: datetime, posts: DataFrame, authors: DataFrame, commands: DataFrame, views: DataFrame, per_author: int = dims.PER_AUTHOR, store: str | None = None):
        self.spark, self.now, self.posts, self.authors, self.commands, self.views, self.per_author = spark, now, posts, authors, commands, views, per_author
        self.store = store

    def _snapshots(self, name: str) -> Snapshots:
        if self.store is None:
            raise ValueError("the engine has no store")
        return Snapshots(self.spark, f"{self.store}/{name}")

    def stories(self) -> Keyed:
        """The table of stories that edition passes keep."""
        return Keyed(self.spark, f"{self.store}/stories", "cluster_id", schema.schema("story_clusters"))

    def rank_pass(self) -> int:
        """Rank and store the buffer; the number of the pass."""
        return self._snapshots("ranked").publish(rank.stored_pass(self.ranked()))

    def edition_pass(self, edition_id: str, feed_name: str = "edition", limit: int = dims.PAGE_SIZE) -> int:
        """Freeze an edition: its page, its row behind those held, and every story's state; the number of the pass."""
        clusters = stored(self.clusters(limit), "clusters")
        page = stored(edition.compacted(edition.items(clusters, self.views, limit)), "page")
        table = self.stories()
        told = clusters.select("cluster_id").union(table.read().where("state <> 'fading'").select("cluster_id")).distinct()
        table.write(lambda rows, _: schema.migrated(cluster.persisted(rows, clusters, self.now), "story_clusters"), told)
        editions = self._snapshots("editions")
        held = editions.read() if editions.versions() else None
        row = edition.frozen(self.spark.createDataFrame([], "feed_name string") if held is None else held, page, feed_name, edition_id, self.now)
        every = row if held is None else edition.retained(held.unionByName(row)).drop("nth")
        editions.publish(stored(every, "editions").coalesce(1))  # at most as many rows as are kept of each feed
        return self._snapshots("page").publish(page.coalesce(1))  # an edition's items

    def frozen_editions(self) -> DataFrame:
        """The editions that are kept, as the last pass left them."""
        return self._snapshots("editions").read()

    def scored(self) -> DataFrame:
        return rank.score_posts(self.posts, self.authors, self.commands, self.now)

    def ranked(self) -> DataFrame:
        return rank.composed(self.scored(), per_author=self.per_author)

    def members(self, limit: int = dims.PAGE_SIZE, spare: int = 10) -> DataFrame:
        """The posts that stories are made of: three times as many as stories are wanted."""
        return cluster.members(self.ranked().where(F.col("rank") <= (limit + spare) * 3))

    def clusters(self, limit: int = dims.PAGE_SIZE) -> DataFrame:
        return cluster.clusters(self.members(limit))

    def edition(self, limit: int = dims.PAGE_SIZE) -> DataFrame:
        return stored(edition.compacted(edition.items(self.clusters(limit), self.views, limit)), "page")

    def freeze(self, held: DataFrame, edition_id: str, feed_name: str = "edition") -> DataFrame:
        """The current edition as one row behind those ``held``."""
        return edition.frozen(held, self.edition(), feed_name, edition_id, self.now)

    def feed_page(self, feed: str, limit: int = dims.PAGE_SIZE, cursor: str | None = None) -> DataFrame:
        """A page of ``ranked`` (behind a score) or of ``edition`` (from an index).

        With a store, ``ranked`` serves the last pass; a cursor is then ``pass:score``, and its page comes from that
        pass while it is kept, whatever was stored since.
        """
        if feed not in FEEDS:
            raise ValueError(f"UnknownFeed: {feed}")
        if not 1 <= limit <= 100:
            raise ValueError("limit is 1 to 100")
        served = self._snapshots(feed if feed == "ranked" else "page") if self.store and self._snapshots(feed if feed == "ranked" else "page").versions() else None
        version = None
        if served and feed == "ranked":
            version, _, cursor = cursor.rpartition(":") if cursor else ("", "", None)
            known = served.versions()
            if version and not version.isdigit():
                raise ValueError(f"BadCursor: {version}")
            version = int(version) if version and int(version) in known else known[-1]
        try:
            at = None if cursor is None else float(cursor) if feed == "ranked" else int(cursor)
        except ValueError:
            raise ValueError(f"BadCursor: {cursor}") from None
        if feed == "ranked":
            page = rank.feed_page(served.read(version) if served else self.ranked(), limit, at)
            behind = F.col("next_cursor").cast("string")
            return page.select("uri", F.col("score_r").alias("score"), (F.concat(F.lit(f"{version}:"), behind) if served else behind).alias("next_cursor"))
        return edition_page(served.read() if served else self.edition(), limit, at or 0)

    def top(self, limit: int = 20) -> DataFrame:
        return self.ranked().where(F.col("rank") <= limit)

    def stinky(self, limit: int = 20) -> DataFrame:
        return rank.author_table(self.authors, self.posts, self.now).where("stink_score > 0.3").orderBy(F.desc("stink_score"), "author_did").limit(limit)

    def lens(self, name: str) -> DataFrame:
        return edition.lens(self.edition(), name)

    def story(self, cluster_id: str) -> DataFrame:
        return edition.story_page(self.members().where(F.col("cluster_id") == cluster_id), self.views).orderBy(F.desc("score"))

    def refresh_graph(self, follows: DataFrame, followers: DataFrame) -> DataFrame:
        return graph.refreshed(self.authors, follows, followers)

    def refresh_counters(self, follows: DataFrame, followers: DataFrame) -> DataFrame:
        return graph.counters(self.authors, follows, followers)

    def purge(self) -> DataFrame:
        return state.purge(self.posts, self.now)


def edition_page(page: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Items of a frozen edition from ``offset``, without docket cards; ``next_cursor`` is null at the end."""
    from pyspark.sql import Window

    rows = page.where(~F.col("is_docket")).withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1)  # an edition's items: 30 at most
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("next_cursor", F.when(total > offset + limit, F.lit(offset + limit).cast("string")))
    return rows.where((F.col("i") >= offset) & (F.col("i") < offset + limit)).select("uri", "i", "next_cursor")
