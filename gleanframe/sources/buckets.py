"""Tables of a shared folder that are written bucketed and read in place, without a name in the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, path: str, buckets: int, by: list[str]) -> None:
    """``df`` as parquet files below ``path``, cut into buckets by a hash of ``by``.

    Where ``df`` is hash-partitioned by the same columns into as many partitions, every bucket is one file.
    """
    name = f"gleanframe_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, buckets: int, by: list[str]) -> DataFrame:
    """The table below ``path`` as a bucketed scan: joins and groups by ``by`` need no exchange of it."""
    name = f"gleanframe_{uuid.uuid4().hex}"
    keys = ", ".join(f"`{b}`" for b in by)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    df = spark.table(name)
    df.schema  # noqa: B018  resolved here, so that the name can go
    spark.sql(f"DROP TABLE {name}")
    return df


def fields_of(df: DataFrame, columns: list[str] | None = None) -> str:
    """The schema of ``df`` as a list of columns for :func:`read_bucketed`."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if columns is None or f.name in columns)
