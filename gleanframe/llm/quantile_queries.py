"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.keys import real_key
from gleanframe.functions.timestamps import with_instant
from gleanframe.llm import quantiles as Q
from gleanframe.sources import table

SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: Posting hours and days are read on clocks of UTC+8.
_CLOCK_US = 8 * 3_600_000_000


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings; null and negative (placeholder) impressions are no measurements."""
    return table(spark, sf_dir, "tweet_metrics").where("impressions >= 0")


def _post_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting hour and day per post; of several rows for a post the earliest instant holds."""
    posts = table(spark, sf_dir, "images").select(real_key(F.col("tweet_id")).alias("tweet_id"), "posted_at", "wall_zone")
    posts = with_instant(posts.where("tweet_id is not null"), "posted_at", "wall_zone", "us")
    posts = posts.groupBy("tweet_id").agg(F.min("us").alias("us")).where("us is not null")
    at = F.timestamp_micros(F.col("us") + _CLOCK_US)
    return posts.select("tweet_id", F.hour(at).alias("posting_hour"), F.to_date(at).alias("posting_day"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of impressions per snapshot and posting hour, and per snapshot and posting day (UTC+8).

    ``period_kind`` is ``hour``, ``day`` or ``all`` (the whole snapshot, also posts without a posting time).
    """
    rows = _readings(spark, sf_dir).select("snapshot_no", real_key(F.col("tweet_id")).alias("tweet_id"), "impressions")
    # one summary per snapshot, post and input partition before the join, so a pinned post is a few rows
    by_post = Q.summarise(rows, ["snapshot_no", "tweet_id"], F.col("impressions"))
    placed = by_post.join(_post_times(spark, sf_dir), "tweet_id", "left")
    kinds = F.array(
        F.struct(F.lit("all").alias("period_kind"), F.lit("all").alias("period")),
        F.struct(F.lit("hour").alias("period_kind"), F.lpad(F.col("posting_hour").cast("string"), 2, "0").alias("period")),
        F.struct(F.lit("day").alias("period_kind"), F.col("posting_day").cast("string").alias("period")),
    )
    placed = placed.select("snapshot_no", "n", "v", "lo", "hi", F.inline(F.filter(kinds, lambda k: k["period"].isNotNull())))
    keys = ["snapshot_no", "period_kind", "period"]
    return Q.percentiles(Q.merge(Q.regroup(placed, keys), keys), keys, SHARES)


def _by_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).select(real_key(F.col("tweet_id")).alias("tweet_id"), "impressions").where("tweet_id is not null")
    return Q.summarise(rows, ["tweet_id"], F.col("impressions")).join(_post_times(spark, sf_dir), "tweet_id")


def p6_by_posting_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of impressions per UTC+8 posting hour."""
    return Q.percentiles(Q.merge(Q.regroup(_by_post(spark, sf_dir), ["posting_hour"]), ["posting_hour"]), ["posting_hour"], SHARES)


def p6_by_posting_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of impressions per UTC+8 posting day."""
    return Q.percentiles(Q.merge(Q.regroup(_by_post(spark, sf_dir), ["posting_day"]), ["posting_day"]), ["posting_day"], SHARES)


def p6_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of impressions per snapshot."""
    keys = ["snapshot_no"]
    return Q.percentiles(Q.merge(Q.summarise(_readings(spark, sf_dir), keys, F.col("impressions")), keys), keys, SHARES)


def p6_all_from_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over everything, combined from the finished summaries of the snapshots."""
    by = Q.merge(Q.summarise(_readings(spark, sf_dir), ["snapshot_no"], F.col("impressions")), ["snapshot_no"])
    whole = Q.merge(Q.regroup(by.withColumn("part", F.lit("all")), ["part"]), ["part"])
    return Q.percentiles(whole, ["part"], SHARES)


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot the readings, and of how many percentiles the value's true ranks lie beyond the reported error."""
    rows, found = _readings(spark, sf_dir).select("snapshot_no", F.col("impressions").cast("double").alias("x")), p6_by_snapshot(spark, sf_dir)
    both = rows.join(found, rows.snapshot_no.eqNullSafe(found.snapshot_no)).drop(rows.snapshot_no)  # a row per snapshot on one side
    ranks = [r for name in SHARES for r in (F.count_if(F.col("x") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("x") <= F.col(name)).alias(f"{name}_up_to"))]
    ranked = both.groupBy("snapshot_no", "n", "rank_error").agg(F.count("*").alias("readings"), *ranks)
    wanted = {name: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) for name, p in SHARES.items()}
    off = [((F.col(f"{k}_below") + 1 > wanted[k] + F.col("rank_error")) | (F.col(f"{k}_up_to") < wanted[k] - F.col("rank_error"))).cast("int") for k in SHARES]
    wide = F.col("rank_error") > F.ceil(F.lit(Q.EPS) * F.col("n"))
    return ranked.select("snapshot_no", F.col("readings").alias("n"), sum(off, F.lit(0)).cast("bigint").alias("outside"), (wide | (F.col("n") != F.col("readings"))).alias("wrong"))


def queries() -> dict:
    return {
        "p6_percentiles": p6_percentiles,
        "p6_by_posting_hour": p6_by_posting_hour,
        "p6_by_posting_day": p6_by_posting_day,
        "p6_by_snapshot": p6_by_snapshot,
        "p6_all_from_snapshots": p6_all_from_snapshots,
        "p6_check": p6_check,
    }


def oracle_sql() -> dict[str, str]:
    return {"p6_check": "SELECT snapshot_no, count(*) AS n, 0::BIGINT AS outside, false AS wrong FROM tweet_metrics WHERE impressions >= 0 GROUP BY snapshot_no"}
