"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on one machine, a temporary folder made once."""
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
    """Writes ``df`` as a table into the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "ord") -> DataFrame:
    """``df`` with a number from 1 by ``order`` within ``keys``, like ``row_number``, without bringing a
    key's rows into one task: rows are dealt by range and counted, and each range numbered on
    from what the ranges before it hold. Null keys are a group of their own. ``df`` is written first, as telling
    ranges reads it twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    ranged = cut(cut(df).select("*", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns[: len(keys)])]).alias("__key")).repartitionByRange(parts, *columns).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__key").alias("__key2"), F.col("__part").alias("__part2"), F.coalesce(before, F.lit(0)).alias("__before"))
    local = ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__key", "__part").orderBy(*columns[len(keys):])))
    joined = local.join(starts, (F.col("__part") == F.col("__part2")) & F.col("__key").eqNullSafe(F.col("__key2")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("__before") + F.col("__own")).cast("long").alias(name))


def cut_counted(df: DataFrame, where: str = "true") -> tuple[DataFrame, int]:
    """``cut``, and the number of rows (those of ``where``) as the write itself has seen it, without another job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(where)).alias("n")))
    n = seen.get.get("n")
    return out, out.where(where).count() if n is None else n
