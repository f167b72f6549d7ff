"""Queries of the general problems 1, 3, 4 and 5 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.keys import month_number, month_text, real_key
from gleanframe.functions.timestamps import CANONICAL, with_instant
from gleanframe.operators import references, rolling, snapshots
from gleanframe.sources import table


# ---- problem 1
def _live_posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One reading per snapshot and post, and the order of the snapshots present."""
    raw = table(spark, sf_dir, "tweet_metrics").select("metric_id", "tweet_id", "fetched_at", "wall_zone", "snapshot_no", "impressions")
    order = snapshots.snapshot_order(raw, "snapshot_no")
    rows = raw.where(F.col("snapshot_no").isNotNull()).withColumn("tweet_id", real_key(F.col("tweet_id"))).where("tweet_id is not null")
    rows = with_instant(rows, "fetched_at", "wall_zone", "instant")
    rows = snapshots.latest_rows(rows, ["snapshot_no", "tweet_id"], [F.col("instant"), F.col("metric_id")], ["impressions"])
    return rows, order


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts added, removed or changed between neighbouring snapshots."""
    rows, order = _live_posts(spark, sf_dir)
    out = snapshots.NeighbourIndex(rows, order, "snapshot_no", ["tweet_id"], ["impressions"]).changes()
    return out.select(F.col("snapshot_no").cast("bigint").alias("snapshot_no"), "tweet_id", "change_kind")


def p1_changes_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes with old and new impressions."""
    rows, order = _live_posts(spark, sf_dir)
    return snapshots.NeighbourIndex(rows, order, "snapshot_no", ["tweet_id"], ["impressions"]).changes_with_values()


# ---- problem 3
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images")
    ledger = table(spark, sf_dir, "asset_index")
    metrics = table(spark, sf_dir, "tweet_metrics")
    arrived = month_number(F.col("loaded_at"))
    parents = references.parent_spans(
        ledger, "images", real_key(F.col("asset_id")), arrived, month_number(F.col("deleted_at")) - 1
    ).unionByName(references.parent_spans(images, "tweet_metrics", real_key(F.col("tweet_id")), arrived))
    refs = references.reference_months(images, "images", real_key(F.col("asset_id")), arrived).unionByName(
        references.reference_months(metrics, "tweet_metrics", real_key(F.col("tweet_id")), arrived)
    )
    return references.orphans(parents, refs)



def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a standing target, per table and month of arrival."""
    return _orphans(spark, sf_dir).select(
        F.col("relation").alias("ref_table"), F.col("key").alias("ref_key"), month_text(F.col("month")).alias("period")
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan keys and rows per table and month."""
    found = _orphans(spark, sf_dir).groupBy("relation", "month").agg(F.count("*").alias("orphan_keys"), F.sum("n").alias("orphan_rows"))
    return found.select(F.col("relation").alias("ref_table"), month_text(F.col("month")).alias("period"), "orphan_keys", "orphan_rows")


# DuckDB's trim takes the characters to strip; these are the outer blanks that the keys carry.
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def _sql_key(c: str) -> str:
    return f"nullif(nullif(trim({c}, {_BLANKS}), ''), 'DRYRUN')"


_P3_CASES = f"""
WITH refs AS (
  SELECT 'images' AS ref_table, {_sql_key("asset_id")} AS ref_key, date_trunc('month', loaded_at)::timestamp AS m, count(*) AS n FROM images GROUP BY ALL
  UNION ALL
  SELECT 'tweet_metrics', {_sql_key("tweet_id")}, date_trunc('month', loaded_at)::timestamp, count(*) FROM tweet_metrics GROUP BY ALL
), targets AS (
  SELECT 'images' AS ref_table, {_sql_key("asset_id")} AS ref_key, loaded_at, deleted_at FROM asset_index
  UNION ALL SELECT 'tweet_metrics', {_sql_key("tweet_id")}, loaded_at, NULL::timestamp FROM images
), cases AS (
  SELECT r.* FROM refs r WHERE r.ref_key IS NOT NULL AND r.m IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM targets t WHERE t.ref_table = r.ref_table AND t.ref_key = r.ref_key
      AND t.loaded_at < r.m + INTERVAL 1 MONTH AND (t.deleted_at IS NULL OR t.deleted_at >= r.m + INTERVAL 1 MONTH))
)
"""


# ---- problem 4
WINDOWS = (7, 30)
MICRO = 1_000_000


def p4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 7- and 30-day totals, averages and maxima per runner and calendar day.

    Of several rows for one runner and day the one that arrived last holds (ties: greatest
    counters). A window without any known counter has a maximum of 0. Averages are per calendar day of the window since the runner's first day. Costs are
    added as whole millionths, so totals do not depend on the order of the rows.
    """
    raw = table(spark, sf_dir, "run_stats").where("date is not null")
    raw = raw.select("runner", "date", "loaded_at", "ai_calls", F.round(F.col("cost_rmb") * MICRO).cast("bigint").alias("cost"))
    order = [F.col(c) for c in ("loaded_at", "ai_calls", "cost")]
    days = snapshots.latest_rows(raw, ["runner", "date"], order, ["ai_calls", "cost"])
    measures = (
        rolling.Measure("ai_calls", "ai_calls"),
        rolling.Measure("cost", "cost"),
        rolling.Measure("ai_calls_max", "ai_calls", "max"),
    )
    out = rolling.trailing(days, "runner", "date", WINDOWS, measures)
    cols = ["runner", "date"]
    for w in WINDOWS:
        cost = F.col(f"cost_{w}").cast("double") / MICRO
        cols += [
            F.col(f"ai_calls_{w}"),
            (F.col(f"ai_calls_{w}").cast("double") / F.col(f"days_{w}")).alias(f"ai_calls_avg_{w}"),
            F.coalesce(f"ai_calls_max_{w}", F.lit(0)).alias(f"ai_calls_max_{w}"),
            cost.alias(f"cost_rmb_{w}"),
            (cost / F.col(f"days_{w}")).alias(f"cost_rmb_avg_{w}"),
        ]
    return out.select(*cols)


_P4_SQL = """
WITH ranked AS (
  SELECT runner, date, ai_calls, CAST(round(cost_rmb * 1000000) AS BIGINT) AS cost,
         row_number() OVER (PARTITION BY runner, date ORDER BY loaded_at DESC NULLS LAST, ai_calls DESC NULLS LAST,
                            CAST(round(cost_rmb * 1000000) AS BIGINT) DESC NULLS LAST) AS rn
  FROM run_stats WHERE date IS NOT NULL
), spans AS (SELECT runner, min(date) AS lo, max(date) AS hi FROM ranked GROUP BY runner
), days AS (SELECT runner, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM spans
), filled AS (
  SELECT d.runner, d.date, date_diff('day', d.lo, d.date) + 1 AS age, r.ai_calls, r.cost
  FROM days d LEFT JOIN ranked r ON r.rn = 1 AND r.runner = d.runner AND r.date = d.date
), w AS (
  SELECT *, least(age, 7) AS d7, least(age, 30) AS d30,
    coalesce(sum(ai_calls) OVER a, 0) AS a7, coalesce(sum(cost) OVER a, 0) AS c7, max(ai_calls) OVER a AS m7,
    coalesce(sum(ai_calls) OVER b, 0) AS a30, coalesce(sum(cost) OVER b, 0) AS c30, max(ai_calls) OVER b AS m30
  FROM filled
  WINDOW a AS (PARTITION BY runner ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY runner ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
SELECT runner, date,
  CAST(a7 AS BIGINT) AS ai_calls_7, CAST(a7 AS DOUBLE) / d7 AS ai_calls_avg_7, coalesce(m7, 0) AS ai_calls_max_7,
  CAST(c7 AS DOUBLE) / 1000000 AS cost_rmb_7, CAST(c7 AS DOUBLE) / 1000000 / d7 AS cost_rmb_avg_7,
  CAST(a30 AS BIGINT) AS ai_calls_30, CAST(a30 AS DOUBLE) / d30 AS ai_calls_avg_30, coalesce(m30, 0) AS ai_calls_max_30,
  CAST(c30 AS DOUBLE) / 1000000 AS cost_rmb_30, CAST(c30 AS DOUBLE) / 1000000 / d30 AS cost_rmb_avg_30
FROM w
"""


# ---- problem 5
def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, metrics = table(spark, sf_dir, "images"), table(spark, sf_dir, "tweet_metrics")
    part = lambda df, name, id_, field: df.select(
        F.lit(name).alias("ref_table"), F.col(id_).alias("row_id"), F.lit(field).alias("field_name"),
        F.col(field).alias("stamp"), "wall_zone",
    )
    return (
        part(images, "images", "id", "posted_at")
        .unionByName(part(images, "images", "id", "processed_at"))
        .unionByName(part(metrics, "tweet_metrics", "metric_id", "fetched_at"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every stamp that is not in the normal form already."""
    rows = _stamps(spark, sf_dir).where(F.col("stamp").isNotNull() & ~F.col("stamp").rlike(CANONICAL))
    out = with_instant(rows, "stamp", "wall_zone", "utc_us", normal=False).where("utc_us is not null")
    return out.select("ref_table", "row_id", "field_name", "utc_us")


def p5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column: stamps, stamps in normal form, other readable ones, unreadable ones, first and last instant."""
    rows = with_instant(_stamps(spark, sf_dir), "stamp", "wall_zone", "us")
    normal = F.col("stamp").rlike(CANONICAL)
    return rows.groupBy("ref_table", "field_name").agg(
        F.count("stamp").alias("stamps"),
        F.count_if(normal & F.col("us").isNotNull()).alias("normal"),
        F.count_if(~normal & F.col("us").isNotNull()).alias("converted"),
        F.count_if(F.col("stamp").isNotNull() & F.col("us").isNull()).alias("unreadable"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_changes_with_values": p1_changes_with_values,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_trailing": p4_trailing,
        "p5_found": p5_found,
        "p5_quality": p5_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3_CASES + "SELECT ref_table, ref_key, strftime(m, '%Y-%m') AS period FROM cases",
        "p3_report": _P3_CASES
        + "SELECT ref_table, strftime(m, '%Y-%m') AS period, count(*) AS orphan_keys, CAST(sum(n) AS BIGINT) AS orphan_rows FROM cases GROUP BY ALL",
        "p4_trailing": _P4_SQL,
    }
