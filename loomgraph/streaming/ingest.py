"""Incremental ingest: files arrive over time, unchanged ones are known by their hash, and only
projects that changed are linked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str = "project_id string, path string, content string, arrived timestamp", files_per_trigger: int = 24) -> DataFrame:
    """Files as they land in a folder of Parquet tables, with ``cache_key``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("cache_key", F.concat("path", F.lit(":"), F.sha2("content", 256)))


def unchanged_dropped(files: DataFrame, within: str = "7 days") -> DataFrame:
    """Each (project, path, content) once; what is remembered is bounded by the watermark."""
    return files.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["project_id", "cache_key"])


def relink(files: DataFrame, link: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Appends each batch of new files and calls ``link`` with the projects it touched; runs what is there, then stops."""

    def batch(df: DataFrame, epoch: int) -> None:
        link(df, epoch)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(files: DataFrame) -> DataFrame:
    """Files and characters by project so far, for update mode."""
    return files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> DataFrame:
    """Copies new files from ``source`` to a table at ``target`` in micro-batches, once each by
    content, and returns the table. A batch that is repeated after a failure replaces itself."""

    def append(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    relink(unchanged_dropped(file_stream(spark, source)), append, checkpoint).awaitTermination()
    return spark.read.parquet(target)


CHANGES = "project_id string, path string, content string, deleted boolean, arrived timestamp"


def ingest_graphs(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Keeps the linked graphs of projects up to date with files that come, change and go.

    ``source``: a folder in which Parquet tables of ``CHANGES`` land; ``deleted`` (null: false) takes a file away. Of several rows of a file in a batch the
    latest counts. Under ``target``, each batch writes the files that it really changed (by content), the projects these belong to, and the whole
    graph of these projects, to a folder of its own, so that a batch repeated after a failure replaces itself. Projects without a change aren't touched; ``latest`` gives
    each project's rows of its last batch. Rows without a project or path are left out.
    """
    from loomgraph.operators import story
    from loomgraph.sources import scripts

    def batch(df: DataFrame, epoch: int) -> None:
        last = Window.partitionBy("project_id", "path").orderBy(F.desc("arrived"), F.desc("content"))
        news = df.where("project_id is not null and path is not null").withColumn("nth", F.row_number().over(last)).where("nth = 1")
        news = news.select("project_id", "path", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.when(~F.coalesce("deleted", F.lit(False)), F.coalesce("content", F.lit(""))).alias("content"))
        log = _epochs(spark, f"{target}/files", "project_id string, path string, deleted boolean, content string").where(F.col("epoch") < epoch)
        known = _last_of(log, ["project_id", "path"]).where("not deleted").select("project_id", "path", F.col("content").alias("was"))
        changed = news.join(known, ["project_id", "path"], "left").where(~F.col("content").eqNullSafe(F.col("was"))).drop("was")
        changed.write.mode("overwrite").parquet(f"{target}/files/epoch={epoch}")
        fresh = _epochs(spark, f"{target}/files", "project_id string, path string, deleted boolean, content string").where(F.col("epoch") <= epoch)
        touched = fresh.where(F.col("epoch") == epoch).select("project_id").distinct()
        touched.write.mode("overwrite").parquet(f"{target}/projects/epoch={epoch}")
        files = _last_of(fresh.join(touched, "project_id", "left_semi"), ["project_id", "path"]).where("not deleted").select("project_id", "path", F.col("path").alias("name"), "content")
        graph = story.linked(scripts.file_order(files).drop("name"))
        graph.nodes.write.mode("overwrite").parquet(f"{target}/nodes/epoch={epoch}")
        graph.edges.write.mode("overwrite").parquet(f"{target}/edges/epoch={epoch}")

    stream = spark.readStream.schema(CHANGES).parquet(source)
    relink(stream, batch, checkpoint).awaitTermination()


def _epochs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of batches; one without a batch is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if schema is not None and not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema + ", epoch int")
    return (spark.read if schema is None else spark.read.schema(schema + ", epoch int")).parquet(path)


def _last_of(log: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("epoch"))
    return log.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def latest(spark: SparkSession, target: str, table: str) -> DataFrame:
    """``nodes`` or ``edges`` as the last batch of each project left them."""
    last = _epochs(spark, f"{target}/projects").groupBy("project_id").agg(F.max("epoch").alias("epoch"))
    return _epochs(spark, f"{target}/{table}").join(last, ["project_id", "epoch"], "left_semi").drop("epoch")
