"""Intermediate tables that cut lineage, in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get(_KEY, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="stemloom-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """A folder of written tables of one run. A table that was written is read, never computed again,
    so a lost executor costs the tasks in flight and no more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        schema = df.schema
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(conf).delete(path, True)
