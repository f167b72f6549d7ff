"""Queries that run the streaming flows and sinks over the tables and read the result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.session import scratch_path
from gleanframe.sources import table
from gleanframe.sources.logs import append_events, read_events
from gleanframe.streaming import flows


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # a file or a folder of files: the stream source takes either, if written as a pattern
    return flows.file_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)


def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user and hour."""
    out = scratch_path(spark, "ingest")
    rows = _stream(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    flows.ingest_distinct(rows, ["user_id", "hour"], [F.col("ts"), F.col("event_id")], out)
    return spark.read.parquet(out).select("user_id", F.unix_seconds("hour").alias("hour"))


def stream_attempts_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose failures reached 10."""
    out = scratch_path(spark, "breaker")
    flows.attempt_breaker(_stream(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", 10, out)
    return spark.read.parquet(out).select(F.col("key").cast("bigint").alias("user_id"))


def stream_late_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders set aside and kept, from two sinks of one pass."""
    out = scratch_path(spark, "late")
    flows.split_late(_stream(spark, sf_dir, "orders"), F.col("o_orderdate") < F.expr("timestamp'1995-01-01'"), f"{out}/now", f"{out}/late", f"{out}/checkpoint")
    both = [spark.read.parquet(f"{out}/{n}").select("o_orderkey", F.lit(n).alias("branch")) for n in ("now", "late")]
    return both[0].unionByName(both[1])


def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of every user, kept in a versioned table."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return flows.ingest_catalog(rows, "user_id", [F.col("ts"), F.col("event_id")], scratch_path(spark, "catalog")).select("user_id", "event_id")


def log_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON by day and read back, counted by day and outcome."""
    path = scratch_path(spark, "log")
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("outcome"), F.col("user_id").cast("string").alias("asset_id"), F.col("props").alias("detail")
    )
    append_events(events, path)
    return read_events(spark, path).groupBy("date", "outcome").agg(F.count("*").alias("n"), F.sum(F.get_json_object("detail", "$.k").cast("bigint")).alias("k"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_ingest_dedup, stream_attempts_breaker, stream_late_branch, stream_catalog, log_sink_roundtrip)}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_ingest_dedup": "SELECT DISTINCT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour FROM events",
        "stream_attempts_breaker": "SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 10",
        "stream_late_branch": "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'late' ELSE 'now' END AS branch FROM orders",
        "stream_catalog": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
        "log_sink_roundtrip": """SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS outcome, count(*) AS n,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2""",
    }
