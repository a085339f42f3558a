"""Session set-up and table access shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with.

    On a cluster the caller builds its own session; nothing here is needed
    beyond UTC timestamps and adaptive execution, both of which are Spark
    settings that ``spark-submit`` can pass.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("RIDGEWEAVE_DRIVER_MEMORY", "8g"),
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ridgeweave")
    return builder.config(map=settings | conf).getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by any path Spark can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
