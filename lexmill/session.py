"""Session defaults used by tests and the bench; a cluster brings its own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every result of this library assumes (UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_source(spark)


def load(spark: SparkSession, sf_dir: str, table: str):
    """One of the provided parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def share_source(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the folder it lies in (a cluster installs it or ships it)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
