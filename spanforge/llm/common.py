"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold. Texts can be long, so batches are kept small in rows.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that long texts fit the workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def held_out(col: Column, n: int, remainder: int) -> Column:
    """True for ids of the given remainder; a null id is in neither part and counts as not held out."""
    return F.coalesce(id_bucket(col, n) == F.lit(remainder), F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is made only if none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spanforge-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def parts(rows: int) -> int:
    """Partitions for so many short rows. Small tables that are written over and over again would else be mostly files."""
    return max(1, -(-rows // 100_000))


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Run the plan once and go on from a replicated copy in the shared folder, in at most so many partitions."""
    shared_dir(df.sparkSession)
    return (df.coalesce(most) if most else df).checkpoint(eager=True)


def stored(df: DataFrame, most: int | None = None) -> DataFrame:
    """As cut(), but as Parquet: smaller, and later reads skip columns. For larger tables."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/spanforge-{uuid.uuid4().hex}"
    for written in _scopes:
        written.append(path)
    (df.coalesce(most) if most else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def discarded(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that stored() writes inside are deleted at the end, but for those that are taken out of the list. For results that have been written elsewhere by then."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield written
    finally:
        _scopes.remove(written)
        for path in written:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shared:
    """A broadcast value that may hold objects of this package, which executors need not have installed."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held = [value]

    def __getstate__(self):
        return {"sent": self.sent, "held": []}

    @property
    def value(self):
        if not self.held:
            self.held.append(pickle.loads(self.sent.value))
        return self.held[0]


def hash_sample(df: DataFrame, key: Column, seed: int, share: float) -> DataFrame:
    """About the given share of rows, the same ones on every run: those whose hashed key is small."""
    if share >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def texts(column) -> list[str]:
    """An Arrow string column as Python strings; null as empty."""
    return [x or "" for x in column.to_pylist()]


def like(schema, columns: list[list]) -> pa.RecordBatch:
    """A record batch from Python lists, in the order and types of an Arrow schema."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
