"""Append-only JSON event log, a content-addressed response cache, and folder scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "ts timestamp, outcome string, asset_id string, detail string"


def append_events(events: DataFrame, path: str) -> None:
    """Append decision events (``ts``, ``outcome``, ``asset_id``, ``detail``) under one folder per UTC day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    events.select("ts", "outcome", "asset_id", "detail", day.alias("date")).write.mode("append").partitionBy("date").json(path)


def read_events(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Events of all days or of one; the day prunes folders. Unreadable lines have null fields."""
    rows = spark.read.schema(EVENT_SCHEMA + ", date string").json(path)
    return rows.where(F.col("date") == day) if day else rows


class ResponseCache:
    """Responses by content key, written in batches; the first response of a key holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self) -> DataFrame:
        schema = "key string, response string, shard string"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def lookup(self, requests: DataFrame, key: Column) -> DataFrame:
        """Requests with ``response``, null on a miss."""
        keyed = requests.withColumn("__key", key)
        hits = self._stored().groupBy("key").agg(F.min("response").alias("response")).withColumnRenamed("key", "__key")
        return keyed.join(hits, "__key", "left").drop("__key")

    def put(self, responses: DataFrame) -> None:
        """Add ``key``, ``response`` rows whose key is not stored, in folders by the key's first two digits."""
        new = responses.where("key is not null").groupBy("key").agg(F.min("response").alias("response"))
        new = new.join(self._stored().select("key"), "key", "left_anti")
        new.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(self.path)


def scan_folder(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,heic}", with_content: bool = False) -> DataFrame:
    """Files of a folder tree with size, time and, if asked, content; columns not asked for are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files if with_content else files.drop("content")


def first_files(files: DataFrame, n: int, newest: bool = False) -> DataFrame:
    """The first ``n`` files by path, or the newest ``n``."""
    order = [F.desc("modificationTime"), F.col("path")] if newest else [F.col("path")]
    return files.orderBy(*order).limit(n)


def rates(spark: SparkSession, path: str, models_field: str = "models") -> DataFrame:
    """A nested JSON table of ``{name: {field: number}}`` as rows ``name``, ``field``, ``value``; a bad file has no rows."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"{models_field} map<string, map<string, double>>").alias("j"))
    by = parsed.select(F.explode(F.col(f"j.{models_field}")).alias("name", "fields"))
    return by.select("name", F.explode("fields").alias("field", "value"))
