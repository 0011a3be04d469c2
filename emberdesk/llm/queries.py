"""The registered queries of the corpus operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, ann, bpe, dac, lloyd, neardup, packing, privacy, quality, secrets, suffixes, toxicity, whiten
from .common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), capacity=2048, end_id=0)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir), window=200)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.dedup(documents(spark, sf_dir), window=20)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find(documents(spark, sf_dir))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir), threshold=0.8)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_ranges(documents(spark, sf_dir), end_id=2)


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.codes_with_errors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_suffix_array_dedup, op3_quality_rules, op4_secret_scan, op5_substring_dedup, op6_personal_data, op7_nearest_vectors, op8_prob_minhash, op9_bpe_round_trip,
        op10_token_files, op11_filtering_lloyd, op12_nearest_labelled, op13_tiled_whitening,
    )
    return {f.__name__: f for f in found}


def _lloyd_sql() -> str:
    """Every round in whole numbers: assign all parts to their nearest entries, then replace entries by floored means."""
    parts, entries = lloyd.PARTS, lloyd.ENTRIES
    far = "list_sum(list_transform(list_zip(t.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = {
        "kept": f"""SELECT vec_id, label, list_transform(embedding, lambda x: floor({lloyd.SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS i, len(embedding) // {parts} AS w
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0""",
        "parts": f"SELECT i, vec_id, label, p, v[p * w + 1 : p * w + w] AS x FROM kept, range({parts}) r(p)",
        "book0": f"SELECT p, i - 1 AS e, x FROM parts WHERE i <= {entries}",
    }
    for k in range(lloyd.ROUNDS + 1):
        ctes[f"near{k}"] = f"SELECT t.i, t.p, min(({far}, c.e)) AS m FROM parts t JOIN book{k} c USING (p) GROUP BY 1, 2"
        ctes[f"cells{k}"] = f"SELECT p, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT p, m[2] AS e, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM parts JOIN near{k} USING (i, p)) GROUP BY 1, 2, 3"
        ctes[f"book{k + 1}"] = f"SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS x FROM cells{k} GROUP BY 1, 2) n USING (p, e)"
    k = lloyd.ROUNDS
    ctes.pop(f"cells{k}"), ctes.pop(f"book{k + 1}")
    ctes["coded"] = f"SELECT i, string_agg(lpad(lower(hex(m[2])), 2, '0'), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM near{k} GROUP BY 1"
    ctes["rows"] = "SELECT vec_id, label, code, error FROM kept JOIN coded USING (i)"
    digest = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{k})"
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({q})" for name, q in ctes.items()) + f" SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM rows"


def oracle_sql() -> dict[str, str]:
    return {"op11_filtering_lloyd": _lloyd_sql()}
