"""Where intermediate tables live, values that go to all executors, and filters of bounded size."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``. Where that is unset, a private folder serves a local master (tests);
    on a cluster it is an error, as executors would write to disks that the others do not see."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set(_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Shared:
    """A broadcast whose value travels with the code of its classes, so executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self._sent, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value

    def release(self) -> None:
        """Free the executors' copies; for use once the jobs that need them are done."""
        self._sent.unpersist()

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the actions within go when these end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _table(spark: SparkSession, schema, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return _table(df.sparkSession, df.schema, path)


def materialize_by(df: DataFrame, name: str, key: str, values: list[int]) -> list[DataFrame]:
    """As ``materialize``, with a table (without ``key``) for each value of the integer column ``key``."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    with shuffles_freed(spark):
        df.write.partitionBy(key).parquet(path)
    schema, whole = df.drop(key).schema, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system, out = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for v in values:
        part = f"{path}/{key}={v}"
        if not system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)):
            spark.createDataFrame([], schema).write.parquet(part)
        out.append(_table(spark, schema, part))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def xxhash64_long(x: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for a long column, as unsigned numbers."""
    # The hash's five primes.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    x = np.asarray(x).astype(np.int64).view(np.uint64)
    h = turn(x * p2, 31) * p1 ^ (p5 + np.uint64(42 + 8))
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


class BitFilter:
    """A Bloom filter of well mixed longs, three bits each; packed, ``MOST`` bits (8 MB) at most."""

    MOST = 1 << 26
    #: More entries than this would set most bits.
    ENTRIES = MOST // 8

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(size: int) -> tuple:
        return tuple((shift, size - 1) for shift in (0, 19, 38))

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> BitFilter:
        """Of the only (long) column of ``hashes`` with ``n`` rows; the bits are set by Spark, in pieces of 4 KB. A
        filter that would be too full lets everything through."""
        if n > cls.ENTRIES:
            return cls(np.full(1, 255, np.uint8))
        size = min(max(1 << 16, 1 << int(16 * max(n, 1) - 1).bit_length()), cls.MOST)
        h = F.col(hashes.columns[0])
        place = F.explode(F.array(*(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(mask).cast("long")) + 1 for s, mask in cls._places(size))))
        got = hashes.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        out = np.zeros(size // 8, np.uint8)
        for r in got.toLocalIterator():
            piece = np.frombuffer(bytes(r["bits"]), np.uint8)[: out.size]
            out[(r["k"] - 1) * 4096 :][: piece.size] = piece
        return cls(out)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits.size == 1:
            return np.ones(hashes.size, bool)
        out = np.ones(hashes.size, bool)
        for shift, mask in self._places(8 * self.bits.size):
            at = hashes >> np.uint64(shift) & np.uint64(mask)
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


