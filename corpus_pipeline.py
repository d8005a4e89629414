"""A training corpus in five stages, each one operator over all that the stage before it kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import linededup, mixing, packing, quality, simhash
from loomgraph.llm._util import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is at least one half.

    Null and empty texts are scored like any other; rows that repeat are judged alike; other columns pass through; an empty
    table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, quality.fit(docs, quality.grades(labels)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that an earlier document has; all documents stay.

    A null text stays null; a document of copies only keeps its row with an empty text; ``n_chars``, if there is one,
    follows the text; other columns pass through; an empty table stays empty.
    """
    short = linededup.dedup(docs, counts=False)
    if "n_chars" not in docs.columns:
        return short
    return short.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Texts without a word are one group; of rows that tie one stays; rows without a doc_id come after all others; other
    columns pass through; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources come near their targets.

    Documents without a word aren't taken; a null source is a source of its own; other columns pass through; an empty table
    stays empty.
    """
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: the token ids with their place in document and sequence.

    A null or empty text is one end token; null doc_ids come first; rows that repeat are documents of their own; other columns
    are dropped; an empty table gives no piece. Reruns over the same rows agree.
    """
    pieces = packing.pack(docs, packing.public_vocabulary())
    return packing.digest(pieces, "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashes, trained weights and a tokenizer are beyond SQL; tests hold quality and SimHash against brute force, the others against what they keep.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
