"""Tables in the folder that the driver and all executors share, and prefix sums.

Lineage is cut with written tables only: they outlive a lost executor.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tributary-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local master without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


class Scratch:
    """A new folder of written tables under the shared root."""

    watchers: list[list[Scratch]] = []  # lists that take in every folder opened while they are here

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        for found in self.watchers:
            found.append(self)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back, with its schema even where it has no rows."""
        writer = df.write.mode("errorifexists").option("compression", compression)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, or the whole folder if none is named."""
        for name in names or ("",):
            self._delete(f"{self.path}/{name}" if name else self.path)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def opened() -> Iterator[list[Scratch]]:
    """The folders that are opened inside."""
    found: list[Scratch] = []
    Scratch.watchers.append(found)
    try:
        yield found
    finally:
        Scratch.watchers.remove(found)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that nothing refers to any more; it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and a worker, both of which hold some of them at a time.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_BYTES``, or one row where it is longer.

    A limit that the session already has stays as it is.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    names = df.columns
    if not any(mark in n for n in names for mark in ".`"):
        return df.mapInArrow(run, schema)
    # mapInArrow takes such names apart
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)
