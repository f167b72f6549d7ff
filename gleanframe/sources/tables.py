"""Readers for the engine's tables (one Parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; pruning and pushdown are left to the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
