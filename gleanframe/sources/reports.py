"""Reports and audit texts as text files of a shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_lines(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The rows of a small summary as lines of a Markdown table, in order below its head: ``line``."""
    row = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    body = df.select(F.lit(1).alias("__part"), F.struct(*order).alias("__order"), row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |", 0), ("|" + " --- |" * len(columns), 1)], "line string, __at int")
    head = head.select(F.lit(0).alias("__part"), F.lit(None).cast(body.schema["__order"].dataType).alias("__order"), "line", "__at")
    return head.unionByName(body.withColumn("__at", F.lit(0))).orderBy("__part", "__at", "__order").select("line")


def append_report(lines: DataFrame, path: str) -> None:
    """Add the lines, as one file, to the report below ``path``."""
    lines.coalesce(1).write.mode("append").text(path)


def replace_latest(lines: DataFrame, path: str) -> None:
    """Put the lines in the place of the last ones."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def append_audit(texts: DataFrame, path: str) -> None:
    """Prompts and answers (``day``, ``kind``, ``name``, ``text``), one JSON line each, in folders by day and kind."""
    texts.select("day", "kind", "name", "text").write.mode("append").partitionBy("day", "kind").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, text string, day string, kind string").json(path)
