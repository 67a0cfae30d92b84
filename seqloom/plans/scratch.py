"""Intermediate tables in the folder that the driver and all executors share."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, a private folder serves a local master, and a
    cluster gets an error."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set(_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the writes within go when these end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = _path(spark, path)
    system.delete(p, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    system, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(p) if s.isDirectory()) if system.exists(p) else []


def dense_ids(df: DataFrame, order: list[str], id_col: str = "seq_id") -> DataFrame:
    """Ids from 0 in the order of ``order``: range partitions are numbered within, and begin where those before end, so
    no task sorts all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("dense_place", F.monotonically_increasing_id())
    rows = cut(rows, "dense").withColumn("dense_part", F.shiftright("dense_place", 33))
    n = rows.groupBy(F.col("dense_part").alias("dense_own")).agg(F.count("*").alias("dense_n"))
    first = n.select("dense_own", (F.sum("dense_n").over(Window.orderBy("dense_own")) - F.col("dense_n")).alias("dense_first"))  # a row a partition
    out = rows.join(first, F.col("dense_part") == F.col("dense_own"))
    number = F.col("dense_first") + F.col("dense_place").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(number.alias(id_col), *(c for c in df.columns if c != id_col))
