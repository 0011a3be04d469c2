"""Looking keys up in batches at a service that answers a limited number of them at once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that one call takes at most.
CHUNK = 25
#: Characters of answers after which a task hands them on.
HANDED = 4_000_000

Answers = dict[str, dict]


def looked_up(keys: DataFrame, key: str, lookup: Callable[[list[str]], Answers], schema: str, chunk: int = CHUNK, partitions: int | None = None, failed: Callable[[list[str], Exception], None] | None = None, by: tuple[Column, ...] = ()) -> DataFrame:
    """A row of ``schema`` for each distinct key that ``lookup`` answers.

    Keys are dealt out by hash, each once, so a key that many rows hold is asked for once, and ``lookup`` is called
    with at most ``chunk`` keys: no more often than a task's keys need. Keys without an answer, and those of a call
    that fails, give no row, as do null keys; ``failed`` is told about such a call. ``lookup`` runs in the tasks.
    ``by`` are the places where a service keeps its answers, told by the key: keys are dealt by the first one instead,
    and asked in their order.
    """
    fields = T.StructType.fromDDL(schema)
    names = fields.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []

        def ask(some: list[str]) -> list[list]:
            try:
                answers = lookup(some)
            except Exception as e:  # one call's failure costs its own keys only
                if failed:
                    failed(some, e)
                answers = {}
            return [[k if n == key else json.dumps(answers[k].get(n)) for n in names] for k in some if k in answers]

        def handed(rows: list[list]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names, dtype=object)

        rows, size = [], 0
        for b in batches:
            held += b[key].tolist()
            whole = len(held) - len(held) % chunk
            for k in range(0, whole, chunk):
                found = ask(held[k : k + chunk])
                rows += found
                size += sum(len(x) for r in found for x in r)
                if size >= HANDED:
                    yield handed(rows)
                    rows, size = [], 0
            held = held[whole:]
        if held:
            rows += ask(held)
        if rows:
            yield handed(rows)

    spark = keys.sparkSession
    every = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct()
    dealt = every.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *(by[:1] or (key,)))
    dealt = dealt.sortWithinPartitions(*by) if by else dealt
    answered = dealt.mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    # Answers travel as JSON, so that nested ones need no Arrow type of their own.
    value = lambda f: F.get(F.from_json(F.concat(F.lit("["), F.col(f.name), F.lit("]")), T.ArrayType(f.dataType)), 0)
    return answered.select(*[F.col(f.name) if f.name == key else value(f).alias(f.name) for f in fields])
