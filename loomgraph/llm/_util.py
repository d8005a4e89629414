"""What the operators of this folder share: cutting lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: ASCII white space, and nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset on one machine (as in tests) a temporary folder is made once a session; on
    a cluster that is an error, as executors wouldn't share it.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back.

    The lineage ends there, so a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def remove(table: DataFrame) -> None:
    """Deletes what ``cut`` wrote, once everything that reads it was written in turn."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges``: columns ``a`` and ``b`` (long). Returns ``node`` and ``component``, the least
    node that is reachable; nodes without an edge to another node don't appear.

    Every round maps each node to the least of itself and its neighbours and contracts the
    graph along that map, so that stars vanish at once and paths halve. A round is one
    aggregation that combines before its shuffle, and joins whose skewed keys Spark splits.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        up = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p")))
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = up.select(F.col("u").alias("component"), "p")
            labels = cut(labels.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        pa = up.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        pb = up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        last, e = e, cut(
            e.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        remove(last)
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
