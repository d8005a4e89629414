"""Exact dedup by a tree-merge of sorted digest runs, with DataFrame operations only.

Every partition of the input is a run of digests. In each round ``FAN`` neighbouring runs become
one (run r goes to r div FAN): equal digests meet, and of each one row goes on with the largest
identifier so far and the number of rows behind it. A group of copies so shrinks with every
round, and no task of a round gets more than ``FAN`` rows of it. The rounds end with a single run,
which lies spread over all tasks by digest.

Digests alone decide for rows whose digest nobody shares. The others are read again and merged by
the same rounds with their bytes beside the digest, so that only texts that are equal byte for byte
become a group, at every level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._util import cut, remove

#: Runs that become one in a round.
FAN = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def merge_runs(runs: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """Merges runs until one is left: a row per value of ``keys`` with ``best`` (largest) and ``n`` (sum).

    ``runs``: ``run`` (int from 0), ``keys``, ``best`` and ``n``. Each round is one aggregation, which
    combines before its shuffle, and is written sorted within its tasks.
    """
    last = runs.agg(F.max("run")).first()[0] or 0
    level, written = runs, None
    while True:
        merged = level.groupBy((F.col("run") / fan).cast("int").alias("run"), *keys).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        last //= fan
        level = cut(merged.sortWithinPartitions(*keys))
        if written is not None:
            remove(written)
        written = level
        if last == 0:
            return level.drop("run")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; a null text counts as an empty one. Of equal texts the row with
    the largest doc_id stays; a null doc_id comes before all others, and of rows that repeat the
    largest doc_id exactly one has ``kept``. ``keep_id`` is null where no row of a group has a
    doc_id. Other columns of ``docs`` are ignored, whatever their names; an empty table gives an
    empty result. ``digest`` may be any function of the text: where different texts share one, their
    bytes still tell them apart.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text")).withColumn("digest", digest(F.col("text")))
    slim = texts.select("doc_id", "digest", sha256(F.col("text")).alias("sha"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))
    slim = cut(slim.sortWithinPartitions("digest"))  # the numbers of rows and runs are fixed from here on
    best = F.struct(F.col("doc_id"), (-F.col("row")).alias("row"))

    shared = merge_runs(slim.select("run", "digest", best.alias("best"), F.lit(1).cast("long").alias("n")), ["digest"], fan)
    suspects = shared.where("n > 1").select("digest")
    again = texts.withColumn("run", F.spark_partition_id()).join(suspects, "digest", "left_semi")
    again = cut(again.select("run", "digest", "text", "doc_id"))
    equal = merge_runs(again.select("run", "digest", "text", F.col("doc_id").alias("best"), F.lit(1).cast("long").alias("n")), ["digest", "text"], fan)

    # a digest of one text: its rows follow the merged digests
    mixed = cut(equal.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    groups = shared.where("n > 1").select(F.col("digest").alias("of"), "best", "n")
    rows = slim if mixed.isEmpty() else slim.join(mixed, "digest", "left_anti")
    joined = rows.join(groups, F.col("digest") == F.col("of"), "left")
    alone = F.col("of").isNull()
    out = joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.when(alone, 1).otherwise(F.col("n")).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == -F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out if mixed.isEmpty() else out.unionByName(_by_bytes(texts, mixed, equal))


def _by_bytes(texts: DataFrame, mixed: DataFrame, equal: DataFrame) -> DataFrame:
    """The rows whose digest belongs to several texts, by their bytes. Few, so that a row of each
    repeated doc_id is chosen by a number that the table of these rows fixes."""
    held = cut(texts.join(mixed, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    firsts = held.groupBy("digest", "text").agg(F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("row"))).alias("best"))
    sizes = equal.select("digest", "text", "n").join(firsts, ["digest", "text"])
    out = held.join(sizes, ["digest", "text"])
    kept = F.col("best.row") == -F.col("row")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex(sha256(F.col("text")))).alias("text_sha256"))


#: DuckDB: equal texts by a window over the table ``documents``.
ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
)
"""
