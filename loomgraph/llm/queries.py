"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import divergence, exactdedup, hamming_topk, lexical, linededup, mixing, nndescent, packing, pii, quality, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(_table(spark, sf_dir, "labels")))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.withColumn("kept", F.col("tail") >= quality.SELECT).drop("text")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_source(_table(spark, sf_dir, "documents"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.of_vectors(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), packing.public_vocabulary()))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(_table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_quality, op3_nn_descent, op4_substring, op5_line_dedup, op6_toxicity, op7_mixing, op8_hamming_topk, op9_packing, op10_pii,
        op11_divergence, op12_exact_dedup, op13_lexical,
    )
}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": linededup.ORACLE_SQL,
    "op8_hamming_topk": hamming_topk.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_exact_dedup": exactdedup.ORACLE_SQL,
    "op13_lexical": lexical.ORACLE_SQL,
}
