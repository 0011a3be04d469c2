"""Near duplicates of word shingles: ProbMinHash signatures, banding, exact verification, classes.

* A text's set: its distinct five-word shingles. Texts with equal sets are one *set* from the start,
  however often each shingle occurs; only one of each is signed and compared, and all get its class.
* Signature: each shingle sends arrivals of a Poisson process whose rate is its weight, each to a random
  register; a register keeps the shingle of its first arrival. Arrivals come in order, so a shingle stops
  once its next one is later than the last register's first. Two registers agree with the probability
  Jaccard similarity of the sets. Every distinct shingle has weight 1, so that this is the similarity
  that is verified: with counts as weights, one line repeated often would hide a near pair.
* Banding: sets that agree on all registers of a band share a bucket. A bucket links its members to
  their leader, the least id, so it makes as many pairs as it has members.
* Verification: the exact Jaccard similarity of the distinct shingles of each pair.
* A member that isn't linked to its leader's class may still be near to another member. Of the sets in
  buckets with several classes, near ones share one of their rarest shingles (a prefix filter at the
  threshold). What both buckets and rare shingles connect, and is of several classes, is compared all
  with all, block by block, as products of membership matrices; of each block's links only as many come
  out as join its sets. No bucket, partner or candidate is capped.
* Classes: connected components of all verified links, by alternating star contractions in the shared
  folder; nothing but a count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import _word_units, rolling
from .common import LEAST_TASKS, batch_of, passing, schema_of, slices, spread, stored, texts
from .encode import forget
from .windows import MIX, NULL_ID, SLICE_BYTES, mixed

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS


def shingle_sets(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, their counts, and where each text's end; each text's are ascending.

    A text of one to four words is one shingle of these; a text without words has none.
    """
    units, ends = _word_units(held)
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    grams = rolling(units, SHINGLE)
    sizes = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(held)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[doc]
    value = np.zeros(len(doc), dtype=np.uint64)
    long = n[doc] >= SHINGLE
    value[long] = grams[place[long]]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        h = np.uint64(int(n[i]))
        for u in units[starts[i] : ends[i]]:
            h = mixed(np.array([h]) * MIX[1] + u)[0]
        value[np.searchsorted(doc, i)] = h
    order = np.lexsort((value, doc))
    value = value[order]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    return value[at], np.diff(np.append(at, len(doc))), np.searchsorted(doc[at], np.arange(len(held)), side="right")


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def prob_minhash(value: np.ndarray, weight: np.ndarray, ends: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first at each register, for each set; 0 rows of a set without shingles."""
    sets = len(ends)
    owner = np.repeat(np.arange(sets), np.diff(np.concatenate([[0], ends])))
    first = np.full(sets * registers, np.inf)
    winner = np.zeros(sets * registers, dtype=np.uint64)
    active, time = np.arange(len(value)), np.zeros(len(value))
    state = value.copy()
    while len(active):
        state = mixed(state + MIX[0])
        time = time - np.log(_uniform(state)) / weight[active]
        state = mixed(state + MIX[2])
        slot = owner[active] * registers + (state % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = value[active[won]]
        late = first.reshape(sets, registers).max(axis=1)
        stay = time < late[owner[active]]
        active, time, state = active[stay], time[stay], state[stay]
    return winner.reshape(sets, registers)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two ascending arrays of distinct values."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


SIGNED = "d long, th long, s1 long, s2 long, n int, buckets array<long>"


def _signed_batches(registers: int, rows: int):
    """The identity of each row's set, its size, and its bucket in every band."""
    out = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int32()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, SLICE_BYTES):
            value, _, ends = shingle_sets([t.encode() for t in b.column(2).to_pylist()])
            s1, s2, at = [], [], 0
            for e in ends.tolist():
                h = xxhash.xxh3_128_intdigest(memoryview(value[at:e]).cast("B") if e > at else b"")
                s1.append(h >> 65)
                s2.append((h & ((1 << 64) - 1)) - (1 << 63))
                at = e
            bands = prob_minhash(value, np.ones(len(value)), ends, registers).reshape(len(ends), -1, rows)
            h = np.zeros(bands.shape[:2], dtype=np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
            for k in range(rows):
                h = mixed(h * MIX[1] + bands[:, :, k])
            flat = pa.array(h.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, bands.shape[1], dtype=np.int32)), flat)
            n = np.diff(np.concatenate([[0], ends])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n), lists], schema=out)

    return run


def _similarity_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of ``a, b`` from their texts; texts of a batch are cut into shingles once."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    for batch in slices(batches, SLICE_BYTES):
        a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
        place: dict[int, int] = {}
        held: list[bytes] = []
        for i, t in [*zip(a, left, strict=True), *zip(b, right, strict=True)]:
            if i not in place:
                place[i] = len(held)
                held.append(t.encode())
        value, _, ends = shingle_sets(held)
        starts = np.concatenate([[0], ends[:-1]])
        cut = [value[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield batch_of(out, [a, b, [jaccard(cut[place[x]], cut[place[y]]) for x, y in zip(a, b, strict=True)]])


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("sid", pa.int64()), ("shingle", pa.int64())])
    for b in slices(batches, SLICE_BYTES):
        value, _, ends = shingle_sets([t.encode() for t in b.column(1).to_pylist()])
        sizes = np.diff(np.concatenate([[0], ends]))
        yield batch_of(out, [np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes), value.view(np.int64)])


def rare_groups(bodies: DataFrame, sids: DataFrame, threshold: float) -> DataFrame:
    """``sid, n, rare``: sets that may be near to another of these, in groups that hold every near pair.

    Of two near sets' shingles, taken rarest first, one of the first ``n - ceil(threshold * n) + 1`` of each
    is shared. Sets are linked to the least one with the same early shingle; ``rare`` names the connected
    groups. Shingles that no other set has come first and link nothing, so most sets are in no group.
    """
    cut = stored(bodies.join(sids, "sid").select("sid", "text").mapInArrow(_shingle_batches, schema_of("sid long, shingle long")), "near-shingles")
    shared = cut.join(cut.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle")
    sizes = cut.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).join(shared.groupBy("sid").agg(F.count(F.lit(1)).alias("m")), "sid")
    early = F.col("m") - F.ceil(F.col("n") * threshold - 1e-9) + 1  # what is left of the prefix behind the shingles of this set alone
    sizes = sizes.select("sid", "n", early.alias("early")).where("early > 0")
    nth = F.row_number().over(Window.partitionBy("sid").orderBy("df", "shingle"))
    prefix = stored(shared.join(sizes, "sid").withColumn("nth", nth).where("nth <= early").select("sid", "shingle"), "near-prefixes")
    least = prefix.groupBy("shingle").agg(F.min("sid").alias("b"), F.max("sid").alias("most")).where("b != most").select("shingle", "b")
    ties = prefix.join(least, "shingle").where("sid != b").select(F.col("sid").alias("a"), "b").distinct()
    return sizes.select("sid", "n").join(components(ties, "near-rare").toDF("sid", "rare"), "sid")


#: Rounds of contraction beyond which something is wrong: enough for paths of any table.
MOST_ROUNDS = 200
#: Links that one task contracts: few links take few tasks, whatever the number of partitions.
TASK_LINKS = 200_000


def _digest(edges: DataFrame):
    """The number of links and a sum of their hashes."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for the nodes of ``links`` (``a, b``), root the least node of each component.

    Alternating contractions: every node sends its larger neighbours to its least one, then its smaller
    ones; a round that changes nothing ends it. Each round is a table in the shared folder. Rounds grow
    with the logarithm of a component's longest path; should they not end, an error is raised.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    seen = _digest(edges)
    for k in range(1, MOST_ROUNDS + 1):
        if not seen[0]:
            break
        tasks = max(LEAST_TASKS, -(-2 * seen[0] // TASK_LINKS))  # a round of few links is not spread over all partitions
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(tasks)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).union(down.select("u", F.col("m").alias("v")).coalesce(tasks)).where("u != v").distinct()
        edges = stored(small.coalesce(tasks), f"{name}-{k}")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links of {name} still change after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select("v", F.col("v").alias("x")).distinct())


def _verified(pairs: DataFrame, bodies: DataFrame, name: str) -> DataFrame:
    left = bodies.select(F.col("sid").alias("a"), F.col("text").alias("left"))
    right = bodies.select(F.col("sid").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return stored(both.mapInArrow(_similarity_batches, schema_of("a long, b long, similarity double")), name)


BLOCK_SHINGLES, BLOCK_SETS = 300_000, 750
COLUMNS = 4096


def _block_links(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        forget()
        value, _, ends = shingle_sets([t.encode() for t in part["text"]])
        sid, sizes = part["sid"].to_numpy(), np.diff(np.concatenate([[0], ends]))
        row = np.repeat(np.arange(len(sid)), sizes)
        _, column, df = np.unique(value, return_inverse=True, return_counts=True)
        shared = df[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sid), len(sid)), dtype=np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [start, start + COLUMNS])
            m = np.zeros((len(sid), COLUMNS), dtype=np.float32)
            m[row[lo:hi], column[lo:hi] - start] = 1
            common += m @ m.T
        near = np.zeros(common.shape, dtype=bool)
        for k in range(0, len(sid), 256):
            exact = common[k : k + 256].astype(np.float64)
            near[k : k + 256] = exact / np.maximum(sizes[k : k + 256, None] + sizes[None, :] - exact, 1) >= threshold
        del common
        np.fill_diagonal(near, True)
        label, last = np.arange(len(sid)), None
        while last is None or (label != last).any():
            last = label
            label = np.concatenate([np.where(near[k : k + 256], last[None, :], len(sid)).min(axis=1) for k in range(0, len(sid), 256)])
            label = label[label]
        x, y = sid[label != np.arange(len(sid))], sid[label[label != np.arange(len(sid))]]
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return run


def _blockwise(pool: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: within the groups that buckets and rare shingles both connect, each set with one that all links join it to.

    A group of one class needs no comparison. Others are cut into blocks of bounded size, and each set goes
    to every pair of blocks with its own; every link lies in one of these, which returns at most one row
    for each of its sets.
    """
    least = pool.groupBy("rare", "band", "bucket").agg(F.min("sid").alias("b"))
    ties = pool.join(least, ["rare", "band", "bucket"]).where("sid != b").select(F.col("sid").alias("a"), "b").distinct()
    grouped = components(ties, "near-groups").withColumnRenamed("node", "sid").join(pool.select("sid", "n", F.col("root").alias("class")).distinct(), "sid")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int")
    sizes = grouped.groupBy("root").agg(blocks.alias("blocks"), F.min("class").alias("one"), F.max("class").alias("other")).where("one != other").select("root", "blocks")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = grouped.join(sizes, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid")
    cells = dealt.join(bodies, "sid").select("root", "i", "j", "sid", "text")
    return stored(cells.groupBy("root", "i", "j").applyInPandas(_block_links(threshold), "a long, b long").distinct(), "near-more")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")


def _classified(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``d, th, class_d, class_th`` for every row."""
    rows = _keyed(docs, id_col, text_col)
    with passing(docs.sparkSession, keep=("near-rows", "near-sets", "near-classes")):
        known = stored(rows.mapInArrow(_signed_batches(REGISTERS, ROWS), schema_of(SIGNED)), "near-rows")
        spread(known.count())
        # One row of each set, the least, stands for it.
        sets = known.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("d", "th")).alias("r"), F.first("buckets").alias("buckets"))
        sets = stored(sets.select("s1", "s2", F.col("r.d").alias("d"), F.col("r.th").alias("th"), F.xxhash64("s1", "s2").alias("sid"), "buckets"), "near-sets")
        signed = sets.select("sid", F.posexplode("buckets").alias("band", "bucket"))
        leaders = signed.groupBy("band", "bucket").agg(F.min("sid").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
        shared = stored(signed.join(leaders, ["band", "bucket"]), "near-buckets")

        candidates = sets.join(shared.select("sid").distinct(), "sid").select("d", "th", "sid")
        bodies = stored(rows.join(candidates, ["d", "th"]).dropDuplicates(["sid"]).select("sid", "text"), "near-bodies")
        scored = _verified(shared.where("sid != leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct(), bodies, "near-scored")
        links = scored.where(F.col("similarity") >= threshold).select("a", "b")
        roots = components(links, "near-first")

        # Buckets with several classes: their sets are compared all with all, in blocks.
        own = shared.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        own = stored(own, "near-own")
        parts = own.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("m"))
        mixed_buckets = parts.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("band", "bucket")
        placed = stored(own.join(mixed_buckets, ["band", "bucket"]), "near-placed")
        enough = rare_groups(bodies, placed.select("sid").distinct(), threshold)
        pool = stored(placed.join(enough, "sid").select("band", "bucket", "sid", "n", "rare", "root"), "near-pool")
        found = _blockwise(pool, bodies, threshold)
        links = links.union(found)
        final = stored(components(links, "near-final"), "near-classes")

    named = sets.drop("buckets").join(final.withColumnRenamed("node", "sid"), "sid", "left").select("s1", "s2", F.coalesce("root", "sid").alias("root"), "d", "th")
    least = named.groupBy("root").agg(F.min(F.struct("d", "th")).alias("head"))
    by_set = named.join(least, "root").select("s1", "s2", F.col("head.d").alias("class_d"), F.col("head.th").alias("class_th"))
    result = known.where("n > 0").join(by_set, ["s1", "s2"]).select("d", "th", "class_d", "class_th")
    alone = known.where("n = 0").select("d", "th", F.col("d").alias("class_d"), F.col("th").alias("class_th"))
    return result.union(alone)


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id`` for every row: the least id of its class.

    Null or empty texts have no shingles: each is a class of its own, of its own id. Null ids stay null
    and count as least within a class. Equal texts are always one class. Rows of one id are one
    document if their texts are equal, else each has its own text's class. An empty table gives none.
    Only the two columns named are read.
    """
    found = _classified(docs, threshold, id_col, text_col)
    return found.select(F.nullif("d", F.lit(NULL_ID)).alias("doc_id"), F.nullif("class_d", F.lit(NULL_ID)).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the least row of each class, by id; columns and their order stay.

    Rows alike in id and text are one document, of which one row stays. Every text without words stays.
    """
    heads = _classified(docs, threshold, id_col, text_col).select(F.col("class_d").alias("__emberdesk_d"), F.col("class_th").alias("__emberdesk_th")).distinct()
    key = ["__emberdesk_d", "__emberdesk_th"]
    keyed = docs.withColumn(key[0], F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(key[1], F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(heads, key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])
