"""Access to the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_of(spark: SparkSession) -> int:
    """How many reduce tasks the session plans for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
