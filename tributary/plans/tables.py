"""Written tables in the folder that the driver and all executors share.

They cut lineage, outlive a lost executor and keep their sizes, so joins with small ones are planned as such.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tributary-tables-")
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


class Tables:
    """A new folder of tables under the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.saved = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, rows: DataFrame) -> DataFrame:
        """Write the rows and read them back."""
        path = f"{self.path}/{self.saved}"
        self.saved += 1
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
