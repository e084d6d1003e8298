"""Shared helpers: table access, scratch tables in the shared folder, Arrow batch mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset (tests in local mode,
    where all tasks run in this process's machine) a folder is made and removed at exit.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


#: Spark removes the shuffle files of a query when it has ended; else they stay until the driver collects garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def spent_shuffles_removed(spark: SparkSession):
    """Within, shuffle files go with the write that needed them: a written table needs no lineage to be read again."""
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def _remove(jvm, conf, path: str) -> None:
    """Delete a folder of a driver that ends; one whose JVM has gone leaves it."""
    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    except (Py4JError, OSError):
        pass


class Scratch:
    """Tables written once to the shared folder and read back: cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        # results read these tables lazily, so they stay as long as the driver runs
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), self.root)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet under this scratch folder; returns the table read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with spent_shuffles_removed(self.spark):
            df.write.option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a scratch table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that an Arrow batch is filled up to. Spark's own bound is 64 MB, which executor and Python worker hold several times over.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Apply ``f`` to each Arrow batch; it returns one batch, several, or None.

    The session's batches are of ``BATCH`` bytes from then on, unless it has a bound of its own; one row may be larger.
    """
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH)

    def run(batches):
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
            del batch, out
        # the worker stays for other tasks
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def apart(columns: list[str]) -> str:
    """A prefix that no column's name begins with, for columns of our own beside any others."""
    prefix = "__own_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc32_mod(id_col: str, m: int):
    """crc32 of the id's decimal text, modulo m (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)
