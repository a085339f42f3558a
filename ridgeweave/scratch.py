"""Intermediate tables in the folder that every executor shares.

Long plans are cut by writing a Parquet table and reading it again. The table
lies under ``spark.checkpoint.dir``, so it outlives any executor. A folder of
our own is only made where that setting is missing, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a new one for local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ridgeweave-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written for one operator call; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, label: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{label}"

    def keep(self, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        return self.spark.read.schema(df.schema).parquet(self.write(df, label, partition_by))

    def write(self, df: DataFrame, label: str, partition_by: list[str] | None = None) -> str:
        path = self.path(label)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables that these scans read, once nothing reads them any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if self.root.rsplit("/", 1)[-1] in parent:
                    path = jvm.org.apache.hadoop.fs.Path(parent)
                    path.getFileSystem(conf).delete(path, True)
