"""Queries for the engine's own relational, scalar and sequence operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.functions import scalars as C
from gleanframe.functions import text as T
from gleanframe.functions.keys import real_key
from gleanframe.operators import lookup, sequence, state
from gleanframe.operators.rolling import Measure, trailing
from gleanframe.sources import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"

_OUTER = _BLANKS + " || chr(160) || chr(12288)"


def _key(c: str) -> str:
    return f"nullif(nullif(trim({c}, {_BLANKS}), ''), 'DRYRUN')"


_CODE = f"CASE WHEN regexp_matches(lower(trim(phash, {_BLANKS})), '^[0-9a-f]{{16}}$') THEN ('0x' || lower(trim(phash, {_BLANKS})))::UBIGINT END"
_LATEST = f"""
WITH latest AS (
  SELECT * FROM (
    SELECT {_key("tweet_id")} AS post, impressions, likes, retweets, replies, quotes, bookmarks, loaded_at, metric_id,
      row_number() OVER (PARTITION BY {_key("tweet_id")} ORDER BY loaded_at DESC, metric_id DESC) AS rn
    FROM tweet_metrics) WHERE rn = 1 AND post IS NOT NULL
)
"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "tweet_metrics").withColumn("post", real_key(F.col("tweet_id"))).where("post is not null")
    m = m.select("post", "impressions", "likes", "retweets", "replies", "quotes", "bookmarks", "loaded_at", "metric_id")
    return lookup.latest_per_key(m, "post", [F.col("loaded_at"), F.col("metric_id")])


# ---- latest rows and reports on them
@_query(_LATEST + "SELECT post, coalesce(impressions, 0) AS impressions, loaded_at, metric_id FROM latest")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("post", F.coalesce("impressions", F.lit(0)).alias("impressions"), "loaded_at", "metric_id")


_MEASURES = ("likes", "retweets", "replies", "quotes", "bookmarks")


@_query(
    _LATEST
    + """SELECT count(*) AS posts, CAST(sum(coalesce(impressions, 0)) AS BIGINT) AS total, median(coalesce(impressions, 0)) AS median,
  CAST(sum(coalesce(impressions, 0)) AS DOUBLE) / count(*) AS mean, max(coalesce(impressions, 0)) AS largest,
  count(*) FILTER (WHERE coalesce(likes, 0) + coalesce(retweets, 0) + coalesce(replies, 0) + coalesce(quotes, 0) + coalesce(bookmarks, 0) > 0) AS engaged,
  max(loaded_at) AS as_of FROM latest"""
)
def reach_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.coalesce("impressions", F.lit(0))
    engaged = sum((F.coalesce(m, F.lit(0)) for m in _MEASURES), F.lit(0)) > 0
    return _latest(spark, sf_dir).agg(
        F.count("*").alias("posts"),
        F.sum(seen).alias("total"),
        F.median(seen).alias("median"),
        (F.sum(seen).cast("double") / F.count("*")).alias("mean"),
        F.max(seen).alias("largest"),
        F.count_if(engaged).alias("engaged"),
        F.max("loaded_at").alias("as_of"),
    )


@_query(
    _LATEST
    + """SELECT CAST(hour(loaded_at + INTERVAL 8 HOUR) AS INTEGER) AS hour, count(*) AS posts, median(coalesce(impressions, 0)) AS median,
  repeat('█', greatest(0, least(28, CAST(trunc(median(coalesce(impressions, 0))) AS INTEGER)))) AS bar FROM latest GROUP BY 1"""
)
def median_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour(F.col("loaded_at").cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS"))
    rows = _latest(spark, sf_dir).select(hour.alias("hour"), F.coalesce("impressions", F.lit(0)).alias("seen"))
    by = lookup.exact_median(rows, ["hour"], "seen").withColumnRenamed("n", "posts")
    return by.withColumn("bar", T.bar(F.col("median")))


@_query(
    _LATEST
    + f""", captions AS (SELECT {_key("tweet_id")} AS post, min(caption) AS caption FROM images GROUP BY 1 HAVING post IS NOT NULL)
SELECT coalesce(contains(caption, '#'), false) AS tagged, count(*) AS posts, median(coalesce(impressions, 0)) AS median, count(*) < 10 AS few
FROM captions JOIN latest USING (post) GROUP BY 1"""
)
def ab_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = table(spark, sf_dir, "images").withColumn("post", real_key(F.col("tweet_id"))).where("post is not null")
    captions = captions.groupBy("post").agg(F.min("caption").alias("caption"))
    tagged = F.coalesce(F.contains(F.col("caption"), F.lit("#")), F.lit(False))
    rows = captions.join(_latest(spark, sf_dir), "post").select(tagged.alias("tagged"), F.coalesce("impressions", F.lit(0)).alias("seen"))
    by = lookup.exact_median(rows, ["tagged"], "seen")
    return by.select("tagged", F.col("n").alias("posts"), "median", (F.col("n") < 10).alias("few"))


@_query(_LATEST + "SELECT post, impressions FROM latest ORDER BY coalesce(impressions, 0) DESC, loaded_at, post LIMIT 10")
def top_k_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _latest(spark, sf_dir).orderBy(F.coalesce("impressions", F.lit(0)).desc(), "loaded_at", "post")
    return best.limit(10).select("post", "impressions")


@_query(
    f"""SELECT {_key("tweet_id")} AS post, metric_id, coalesce(impressions - lag(impressions) OVER w, 0) AS gained, CAST(row_number() OVER w AS INTEGER) AS reading
FROM tweet_metrics WHERE {_key("tweet_id")} IS NOT NULL WINDOW w AS (PARTITION BY {_key("tweet_id")} ORDER BY loaded_at, metric_id)"""
)
def reach_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "tweet_metrics").select(real_key(F.col("tweet_id")).alias("post"), "metric_id", "loaded_at", "impressions").where("post is not null")
    month = F.year("loaded_at") * 12 + F.month("loaded_at")
    return sequence.curve(m, "post", month, [F.col("loaded_at"), F.col("metric_id")], "impressions").select("post", "metric_id", "gained", "reading")


# ---- decided or not
_LEDGER = """
WITH ledger AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY loaded_at DESC, decided_at DESC NULLS LAST, seen DESC NULLS LAST) AS rn FROM asset_index) WHERE rn = 1
)
"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("loaded_at"), F.col("decided_at"), F.col("seen")]
    rows = table(spark, sf_dir, "asset_index").where("asset_id is not null")
    return rows.groupBy("asset_id").agg(F.max_by(F.struct("seen", "retire_reason", "retire_score"), F.struct(*order)).alias("k")).select("asset_id", "k.*")


_REVIVE = "coalesce(retire_reason = 'lowq' AND retire_score >= 5, false)"


@_query(_LEDGER + "SELECT i.id, i.asset_id FROM images i LEFT JOIN ledger l ON l.asset_id = i.asset_id AND l.seen = 1 WHERE i.asset_id IS NOT NULL AND l.asset_id IS NULL")
def undecided_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").select("id", "asset_id").where("asset_id is not null")
    return lookup.undecided(images, _ledger(spark, sf_dir), "asset_id", F.col("seen") == 1)


@_query(
    _LEDGER
    + f"""SELECT i.id, i.asset_id FROM images i LEFT JOIN ledger l ON l.asset_id = i.asset_id AND l.seen = 1
WHERE i.asset_id IS NOT NULL AND (l.asset_id IS NULL OR {_REVIVE})"""
)
def undecided_or_revivable(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").select("id", "asset_id").where("asset_id is not null")
    return lookup.undecided(images, _ledger(spark, sf_dir), "asset_id", F.col("seen") == 1, F.expr(_REVIVE))


@_query(_LEDGER + f"SELECT count(*) AS revivable FROM images i JOIN ledger l USING (asset_id) WHERE l.seen = 1 AND {_REVIVE}")
def revivable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _ledger(spark, sf_dir).where(F.expr(f"seen = 1 AND {_REVIVE}"))
    return table(spark, sf_dir, "images").join(back, "asset_id").agg(F.count("*").alias("revivable"))


# ---- counts and roll-ups
@_query(
    """SELECT (SELECT count(*) FROM images WHERE status = 'posted') AS posted, (SELECT count(*) FROM images WHERE status = 'approved') AS approved,
  (SELECT count(*) FROM images WHERE status = 'rejected') AS rejected, (SELECT count(*) FROM asset_index) AS indexed, (SELECT count(*) FROM asset_index WHERE seen = 1) AS seen"""
)
def status_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("posted", "approved", "rejected")])
    index = table(spark, sf_dir, "asset_index").agg(F.count("*").alias("indexed"), F.count_if(F.col("seen") == 1).alias("seen"))
    return images.withColumns({"indexed": index.select("indexed").scalar(), "seen": index.select("seen").scalar()})


@_query(f"SELECT CAST(json_object('posted', posted, 'approved', approved, 'rejected', rejected, 'indexed', indexed, 'seen', seen) AS VARCHAR) AS status FROM ({_SQL['status_overview']})")
def status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview as one JSON object."""
    return status_overview(spark, sf_dir).select(F.to_json(F.struct("*")).alias("status"))


@_query(
    """SELECT s.status, count(i.id) AS n FROM (VALUES ('seen'), ('queued'), ('approved'), ('retired')) s(status)
LEFT JOIN images i ON i.status = s.status GROUP BY 1"""
)
def status_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(s,) for s in ("seen", "queued", "approved", "retired")], "status string")
    counts = table(spark, sf_dir, "images").groupBy("status").agg(F.count("*").alias("n"))
    return wanted.join(counts, "status", "left").na.fill({"n": 0})


@_query(
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS in_24h
FROM events"""
)
def rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("in_24h"))


@_query("SELECT runner, CAST(coalesce(sum(color_calls) FILTER (WHERE CAST(date AS VARCHAR) LIKE '2025-11-%'), 0) AS BIGINT) AS color_calls FROM run_stats GROUP BY 1")
def month_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.when(F.col("date").cast("string").like("2025-11-%"), F.col("color_calls"))
    return table(spark, sf_dir, "run_stats").groupBy("runner").agg(F.coalesce(F.sum(calls), F.lit(0)).alias("color_calls"))


@_query(
    """WITH days AS (SELECT date, CAST(sum(coalesce(ai_calls, 0)) AS BIGINT) AS ai_calls, CAST(sum(coalesce(images_posted, 0)) AS BIGINT) AS posted FROM run_stats GROUP BY 1 ORDER BY date DESC LIMIT 30)
SELECT date, CAST(sum(ai_calls) AS BIGINT) AS ai_calls, CAST(sum(posted) AS BIGINT) AS posted FROM days GROUP BY ROLLUP (date)"""
)
def daily_rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "run_stats").groupBy("date").agg(
        F.sum(F.coalesce("ai_calls", F.lit(0))).alias("ai_calls"), F.sum(F.coalesce("images_posted", F.lit(0))).alias("posted")
    )
    newest = days.orderBy(F.col("date").desc()).limit(30)
    return newest.rollup("date").agg(F.sum("ai_calls").alias("ai_calls"), F.sum("posted").alias("posted"))


@_query(
    """SELECT count(*) AS assets, coalesce(min(attempts), 0) AS least_attempts, max(decided_at) FILTER (WHERE seen = 1) AS last_decided,
  coalesce(min(retire_score) FILTER (WHERE retire_reason = 'none such'), 0) AS empty_min FROM asset_index"""
)
def table_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "asset_index").agg(
        F.count("*").alias("assets"),
        F.coalesce(F.min("attempts"), F.lit(0)).alias("least_attempts"),
        F.max(F.when(F.col("seen") == 1, F.col("decided_at"))).alias("last_decided"),
        F.coalesce(F.min(F.when(F.col("retire_reason") == "none such", F.col("retire_score"))), F.lit(0)).alias("empty_min"),
    )


@_query("SELECT reject_stage, count(*) AS n FROM images WHERE status = 'rejected' GROUP BY 1 ORDER BY n DESC")
def rejects_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "images").where("status = 'rejected'").groupBy("reject_stage").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


@_query(
    """SELECT p_brand, CAST(sum(l_quantity) AS BIGINT) AS units, round(sum(l_quantity * coalesce(rate, 0)) / 1000000, 6) AS weighted
FROM lineitem l LEFT JOIN (SELECT p_partkey, p_brand, round(p_retailprice) AS rate FROM part WHERE p_size <= 40) p ON p.p_partkey = l.l_partkey GROUP BY 1"""
)
def usage_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.round("p_retailprice").alias("rate"))
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    used = lookup.with_default(used, rates, "l_partkey", {"rate": 0.0})
    return used.groupBy("p_brand").agg(F.sum("q").cast("bigint").alias("units"), F.round(F.sum(F.col("q") * F.col("rate")) / 1_000_000, 6).alias("weighted"))


@_query(
    """SELECT l_returnflag, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS d0, count(*) FILTER (WHERE l_linenumber % 4 = 1) AS d90,
  count(*) FILTER (WHERE l_linenumber % 4 = 2) AS d180, count(*) FILTER (WHERE l_linenumber % 4 = 3) AS d270 FROM lineitem GROUP BY 1"""
)
def rotation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.element_at(F.array(*[F.lit(x) for x in ("d0", "d90", "d180", "d270")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", turned.alias("turned"))
    return rows.groupBy("l_returnflag").pivot("turned", ["d0", "d90", "d180", "d270"]).count().na.fill(0)


@_query("SELECT count(*) FILTER (WHERE n = 1) AS agreed, count(*) AS judged FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n"))
    return votes.agg(F.count_if(F.col("n") == 1).alias("agreed"), F.count("*").alias("judged"))


@_query(
    """WITH n AS (SELECT asset_id, lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE asset_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)
SELECT asset_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first) AS rn FROM n) WHERE rn = 1"""
)
def consensus_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").where("asset_id is not null and lang is not null").groupBy("asset_id", "lang")
    n = n.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return n.groupBy("asset_id").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


@_query(
    """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.005) AS low, median(CAST(round(l_extendedprice * 100) AS BIGINT)) AS mid_cents,
  quantile_disc(l_extendedprice, 0.995) AS high FROM lineitem GROUP BY 1"""
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_extendedprice)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    by = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return by.agg(at(0.005).alias("low"), F.median(cents).alias("mid_cents"), at(0.995).alias("high"))


# ---- sequences
@_query(
    """SELECT event_id, round(sum(value) OVER w, 6) AS so_far, CASE WHEN row_number() OVER m <= 100 THEN 0.0 ELSE 0.02 END::DOUBLE AS fee, (row_number() OVER w - 1) % 2 = 0 AS tagged
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), m AS (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id)"""
)
def running_total_quota_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy("ts", "event_id")
    return e.select(
        "event_id",
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("so_far"),
        F.when(F.row_number().over(m) <= 100, 0.0).otherwise(0.02).alias("fee"),
        ((F.row_number().over(w) - 1) % 2 == 0).alias("tagged"),
    )


@_query(
    """SELECT event_id FROM (SELECT event_id, coalesce(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
  coalesce(sum(CASE event_type WHEN 'error' THEN 3 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
WHERE n < 60 AND spent < 80"""
)
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, order = table(spark, sf_dir, "events"), [F.col("ts"), F.col("event_id")]
    e = sequence.spent_before(e, ["user_id"], order, F.lit(1), "n")
    e = sequence.spent_before(e, ["user_id"], order, F.when(F.col("event_type") == "error", 3).otherwise(1), "spent")
    return e.where("n < 60 and spent < 80").select("event_id")


@_query(
    """WITH runs AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS streak FROM runs"""
)
def miss_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sequence.streaks(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "streak")


_ISLANDS = f"""
WITH coded AS (SELECT id, batch_no, {_CODE} AS code, status FROM images WHERE batch_no IS NOT NULL)
"""
_BURSTS = """, flagged AS (SELECT *, CASE WHEN bit_count(xor(code, lag(code) OVER w)) <= 26 THEN 0 ELSE 1 END AS new FROM {src} WINDOW w AS (PARTITION BY batch_no ORDER BY id)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY batch_no ORDER BY id) AS island FROM flagged),
placed AS (SELECT *, (row_number() OVER (PARTITION BY batch_no, island ORDER BY id) - 1) % 3 AS place FROM isl),
numbered AS (SELECT *, sum(CASE WHEN place = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_no ORDER BY id) AS burst FROM placed)
"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "images").where("batch_no is not null").select("id", "batch_no", C.hex_code(F.col("phash")).alias("code"), "status")


@_query(
    _ISLANDS + _BURSTS.format(src="coded")
    + "SELECT id, CAST(burst AS BIGINT) AS burst, CAST(place AS INTEGER) AS place, first_value(id) OVER (PARTITION BY batch_no, burst ORDER BY id) AS head FROM numbered"
)
def burst_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bursts(_coded(spark, sf_dir), ["batch_no"], "id", "code", 26, 3).select("id", "burst", "place", "head")


@_query(
    _ISLANDS
    + ", kept AS (SELECT * FROM coded WHERE status IS DISTINCT FROM 'rejected')"
    + _BURSTS.format(src="kept")
    + """, every AS (SELECT c.id, c.batch_no, n.burst FROM coded c LEFT JOIN numbered n USING (id))
SELECT id, CAST(coalesce(last_value(burst IGNORE NULLS) OVER b, first_value(burst IGNORE NULLS) OVER a, 0) AS BIGINT) AS burst FROM every
WINDOW b AS (PARTITION BY batch_no ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY batch_no ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
)
def burst_with_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sequence.bursts_with_aux(_coded(spark, sf_dir), ["batch_no"], "id", "code", F.col("status") == "rejected", 26, 3)
    return got.select("id", F.coalesce("burst", F.lit(0)).alias("burst"))


@_query()
def burst_by_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts whose rows may also join by nearness to the head; order-dependent, hence no SQL."""
    return sequence.bursts_by_head(_coded(spark, sf_dir), "batch_no", "id", "code", 20, 26, 3).select("id", "batch_no", "burst")


@_query(
    _LEDGER
    + """, w AS (SELECT i.batch_no, i.id, min(i.id) FILTER (WHERE i.status = 'posted') OVER (PARTITION BY i.batch_no) AS first FROM images i WHERE batch_no IS NOT NULL)
SELECT id, CASE WHEN first IS NULL OR id < first THEN 'retired' WHEN id = first THEN 'winner' ELSE 'open' END AS outcome FROM w"""
)
def walk_back_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").where("batch_no is not null").select("id", "batch_no", "status")
    return sequence.walk_back(images, ["batch_no"], "id", F.col("status") == "posted").select("id", "outcome")


@_query(
    """SELECT o_orderkey, CAST(-(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'))
  + row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS rank
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')"""
)
def rank_head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'1997-01-01'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    known = known.withColumn("rank", F.lit(0).cast("bigint"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sequence.head_ranks(known, orders, "o_orderkey", "rank", [F.col("o_orderdate"), F.col("o_orderkey")], F.to_date("o_orderdate")).select("o_orderkey", "rank")




@_query(
    """SELECT asset_id, phase, id FROM (SELECT asset_id, id, phase, row_number() OVER (PARTITION BY asset_id ORDER BY phase, id) AS rn FROM (
  SELECT trim(asset_id, """
    + _BLANKS
    + """) AS asset_id, id, CASE WHEN loaded_at >= TIMESTAMP '2026-05-01' THEN 1 WHEN coalesce(batch_no < 10, false) THEN 3 ELSE 2 END AS phase FROM images)
  WHERE asset_id <> '') WHERE rn = 1"""
)
def three_phase_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").select(real_key(F.col("asset_id")).alias("asset_id"), "id", "loaded_at", "batch_no").where("asset_id is not null")
    phase = F.when(F.col("loaded_at") >= F.expr("timestamp_ntz'2026-05-01'"), 1).when(F.coalesce(F.col("batch_no") < 10, F.lit(False)), 3).otherwise(2)
    return sequence.first_per_phase(images, "asset_id", phase, [F.col("id")]).select("asset_id", "phase", "id")


@_query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def keep_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.newest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 5).select("user_id", "event_id")


# ---- state
@_query(
    "SELECT user_id, event_type AS last_type, event_id AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    last = state.last_per_key(e, "user_id", [F.col("ts"), F.col("event_id")])
    return last.select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_event"))


@_query(
    """WITH s AS (SELECT asset_id, count(*) AS attempts, min(loaded_at) AS first FROM asset_index WHERE loaded_at < TIMESTAMP '2025-09-01' GROUP BY 1),
c AS (SELECT asset_id, count(*) AS attempts, min(loaded_at) AS first FROM asset_index WHERE loaded_at >= TIMESTAMP '2025-09-01' GROUP BY 1)
SELECT coalesce(s.asset_id, c.asset_id) AS asset_id, coalesce(s.attempts, 0) + coalesce(c.attempts, 0) AS attempts, coalesce(s.first, c.first) AS first
FROM s FULL JOIN c ON s.asset_id = c.asset_id"""
)
def upsert_keep_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "asset_index")
    counted = lambda df: df.groupBy("asset_id").agg(F.count("*").alias("attempts"), F.min("loaded_at").alias("first"))
    early, late = (counted(index.where(f"loaded_at {op} timestamp_ntz'2025-09-01'")) for op in ("<", ">="))
    return state.upsert(early, late, "asset_id", [], ["attempts"])


@_query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@_query(
    """SELECT id, digest FROM (SELECT id, lower(trim(sha256)) AS digest, row_number() OVER (PARTITION BY lower(trim(sha256)) ORDER BY batch_no >= 20, id) AS rn FROM images WHERE batch_no IS NOT NULL) WHERE rn = 1"""
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").where("batch_no is not null").select("id", F.lower(F.trim("sha256")).alias("digest"), "batch_no")
    old = state.first_per_key(images.where("batch_no < 20"), "digest", [F.col("id")])
    return state.insert_ignore(old, images.where("batch_no >= 20"), "digest", [F.col("id")]).select("id", "digest")


def _gone_sql(most: int) -> str:
    return f"""WITH gone AS (SELECT DISTINCT {_key("tweet_id")} AS post FROM images WHERE id % 97 = 0 AND {_key("tweet_id")} IS NOT NULL),
hit AS (SELECT i.id, i.status, {_key("i.tweet_id")} AS post, g.post IS NOT NULL AS gone FROM images i LEFT JOIN gone g ON g.post = {_key("i.tweet_id")})
SELECT id, CASE WHEN gone AND (SELECT count(*) FROM hit WHERE gone) <= {most} THEN 'rejected' ELSE status END AS status,
  CASE WHEN gone AND (SELECT count(*) FROM hit WHERE gone) <= {most} THEN NULL ELSE post END AS post FROM hit"""


def _retired(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    images = table(spark, sf_dir, "images").select("id", "status", real_key(F.col("tweet_id")).alias("post"))
    gone = images.where("id % 97 = 0 and post is not null").select("post")
    return state.marked_gone(images, gone, "post", {"status": F.lit("rejected"), "post": F.lit(None).cast("string")}, most).select("id", "status", "post")


@_query(_gone_sql(100_000_000))
def retire_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retired(spark, sf_dir, 100_000_000)


@_query(_gone_sql(0))
def retire_deleted_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retired(spark, sf_dir, 0)


@_query(
    """SELECT id, CASE WHEN status = 'posting' THEN 'approved' ELSE status END AS status, coalesce(CASE WHEN trim(caption) <> '' THEN caption END, alt_text) AS caption
FROM images WHERE status NOT IN ('queued', 'seen')"""
)
def reset_fill_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").where(~F.col("status").isin("queued", "seen"))
    return state.filled(state.moved(images, "status", "posting", "approved"), "caption", F.col("alt_text")).select("id", "status", "caption")


@_query(
    """SELECT i.id, coalesce(u.caption, i.caption) AS caption, coalesce(u.status, i.status) AS status FROM images i
LEFT JOIN (SELECT id, alt_text AS caption, CASE WHEN id % 2 = 0 THEN 'queued' END AS status FROM images WHERE batch_no % 3 = 0) u ON u.id = i.id"""
)
def update_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images")
    updates = images.where("batch_no % 3 = 0").select("id", F.col("alt_text").alias("caption"), F.when(F.col("id") % 2 == 0, "queued").alias("status"))
    return state.update_given(images.select("id", "caption", "status"), updates, "id")


@_query(f"SELECT DISTINCT {_key('asset_id')} AS asset_id FROM images WHERE {_key('asset_id')} IS NOT NULL EXCEPT SELECT asset_id FROM asset_index")
def page_minus_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "images").select(real_key(F.col("asset_id")).alias("asset_id")).where("asset_id is not null").distinct()
    return state.without(page, table(spark, sf_dir, "asset_index"), "asset_id")


@_query(f"SELECT {_key('asset_id')} AS asset_id FROM images WHERE {_key('asset_id')} IS NOT NULL UNION SELECT asset_id FROM asset_index WHERE asset_id IS NOT NULL")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "images").select(real_key(F.col("asset_id")).alias("asset_id"))
    return page.unionByName(table(spark, sf_dir, "asset_index").select("asset_id")).where("asset_id is not null").distinct()


# ---- nearness
@_query(
    f"""WITH c AS (SELECT id, status, batch_no, {_CODE} AS code FROM images)
SELECT p.id FROM c p WHERE p.batch_no >= 24 AND EXISTS (SELECT 1 FROM c k WHERE k.batch_no < 24 AND k.status IS DISTINCT FROM 'rejected' AND bit_count(xor(p.code, k.code)) <= 6)"""
)
def near_dup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _coded(spark, sf_dir)
    kept = coded.where("batch_no < 24 and status <=> 'rejected' = false")
    return lookup.near_semi(coded.where("batch_no >= 24"), kept, "code", 6).select("id")


@_query(
    f"""WITH h AS (SELECT id, status, batch_no, regexp_replace(lower(trim(phash, {_OUTER})), '^(p?hash\\s*[:=]\\s*|0x)', '') AS hex FROM images),
c AS (SELECT id, status, batch_no, CASE WHEN regexp_matches(hex, '^[0-9a-f]{{16}}$') THEN ('0x' || hex)::UBIGINT END AS code FROM h)
SELECT p.id FROM c p WHERE EXISTS (SELECT 1 FROM c k WHERE k.batch_no < p.batch_no AND k.status <> 'rejected' AND bit_count(xor(p.code, k.code)) <= 12)"""
)
def near_dup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every batch whose picture is within 12 bits of one that an earlier batch kept."""
    images = table(spark, sf_dir, "images").select("id", "batch_no", C.picture_code(F.col("phash")).alias("code"), "status")
    return lookup.near_earlier(images, F.col("status") != "rejected", "code", "batch_no", 12).select("id")


@_query(
    """WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 3), s AS (
  SELECT e.vec_id, r.vec_id AS ref, list_cosine_similarity(e.embedding::DOUBLE[], r.v) AS sim FROM embeddings e, r)
SELECT vec_id, round(max(sim), 6) AS similarity FROM s GROUP BY 1"""
)
def cosine_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return lookup.best_reference(e, e.where("vec_id < 3"), "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


@_query("SELECT vec_id, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i::INTEGER ELSE 0 END)) AS BIGINT) AS code FROM embeddings")
def sign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", C.sign_code(F.col("embedding")).alias("code"))


# ---- texts
_W0, _W2 = T.code_class(T.WEIGHTLESS), T.code_class(T.HEAVY)


@_query(
    f"""SELECT doc_id, 2 * length(regexp_replace(text, '{_W0}', '', 'g')) - length(regexp_replace(regexp_replace(text, '{_W0}', '', 'g'), '{_W2}', '', 'g')) AS weight FROM documents"""
)
def weighted_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.weighted_length(F.col("text")).cast("bigint").alias("weight"))


@_query()
def weighted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and alt texts cut to a weighted limit."""
    cut = T.weighted_prefix(F.coalesce("caption", "alt_text"), 60)
    return table(spark, sf_dir, "images").select("id", cut.alias("cut"), T.weighted_length(cut).alias("weight"))


@_query()
def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption, place line and one tag under the limit."""
    line = C.place_line(F.lit("20:45"), F.when(F.col("id") % 3 > 0, F.concat(F.initcap(F.lower("source_filename")), F.lit(", China"))))
    return table(spark, sf_dir, "images").select("id", T.post_text(F.col("caption"), line, "China").alias("post"))


@_query()
def json_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the judge notes that hold or nearly hold a JSON object."""
    notes = table(spark, sf_dir, "documents").where("lower(trim(source)) = 'judge_note'")
    parsed = notes.select("doc_id", T.json_object(F.col("text")).alias("j"))
    get = lambda k: F.get_json_object("j", f"$.{k}")
    return parsed.select("doc_id", C.score_0_10(get("quality")).alias("quality"), get("best_index").try_cast("int").alias("best_index"), get("shows").alias("shows"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@_query(
    """SELECT id, greatest(0, least(10, coalesce(TRY_CAST(regexp_extract(source_filename, '([0-9]+)', 1) AS INTEGER) % 13, 0))) AS score,
  left(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(source_filename, ''), '\\s+', ' ', 'g')), '[^A-Za-z0-9 ]', '_', 'g'), ' ', '-', 'g'), 30) AS label,
  left(sha1(sha256), 16) AS name, nullif(trim(string_split(caption, chr(10))[1]), '') AS first_line, CASE WHEN post_attempts BETWEEN 1 AND 3 THEN post_attempts - 1 ELSE -1 END AS idx,
  least(30 * power(2.0, coalesce(post_attempts, 0)), 300) AS wait FROM images"""
)
def scalar_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source_filename", "([0-9]+)", 1).try_cast("int") % 13
    return table(spark, sf_dir, "images").select(
        "id",
        C.score_0_10(number).alias("score"),
        T.safe_label(F.coalesce("source_filename", F.lit("")), 30).alias("label"),
        C.short_name(F.col("sha256")).alias("name"),
        T.first_line(F.col("caption")).alias("first_line"),
        F.coalesce(C.one_based(F.col("post_attempts"), F.lit(3)), F.lit(-1)).alias("idx"),
        C.backoff(F.coalesce("post_attempts", F.lit(0)) + 1, 30.0, 2.0, 300.0).alias("wait"),
    )


@_query(
    """SELECT o_orderkey, d + m / 60.0 + s / 3600.0 AS north, -(d + m / 60.0 + s / 3600.0) AS south, greatest(0.0, least(1.0, (o_totalprice - 1000.0) / 199000.0)) AS ramp
FROM (SELECT *, CAST(o_orderkey % 90 AS DOUBLE) AS d, CAST(o_custkey % 60 AS DOUBLE) AS m, CAST(o_orderkey % 60 AS DOUBLE) AS s FROM orders)"""
)
def degrees_and_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda e: F.expr(f"cast({e} as double)")
    dms = [part("o_orderkey % 90"), part("o_custkey % 60"), part("o_orderkey % 60")]
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        C.degrees(*dms, F.lit("N")).alias("north"),
        C.degrees(*dms, F.lit("s")).alias("south"),
        C.ramp(F.col("o_totalprice"), 1000.0, 200000.0).alias("ramp"),
    )


@_query(
    """SELECT event_id, mi >= 60 AND mi < 720 AS by_day, mi >= 1320 OR mi < 120 AS by_night FROM (
  SELECT event_id, hour(ts + INTERVAL 8 HOUR) * 60 + minute(ts + INTERVAL 8 HOUR) AS mi FROM events)"""
)
def daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = C.local_minute(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        C.in_window(minute, *C.clock_minutes("01:00-12:00")).alias("by_day"),
        C.in_window(minute, *C.clock_minutes("22:00-02:00")).alias("by_night"),
    )


@_query(
    """SELECT p_partkey, CASE WHEN p_type ILIKE 'standard%' THEN 'a' WHEN p_type ILIKE 'promo%' THEN 'b' ELSE 'other' END AS kind, contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') AS named FROM part"""
)
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.by_prefix(F.col("p_type"), {"standard": "a", "promo": "b"}, "other").alias("kind"),
        C.matches_any(F.col("p_name"), ["red", "blue"]).alias("named"),
    )


@_query(
    """SELECT c_custkey, CASE WHEN abs(lat) > 1e-6 OR abs(lon) > 1e-6 THEN printf('%.3f', round(lat, 3)) || ',' || printf('%.3f', round(lon, 3)) END AS cell,
  nullif(concat_ws(', ', coalesce(nullif(trim(city), ''), c_mktsegment), nullif(trim(n_name), '')), '') AS place,
  CASE WHEN substr(stamp, 12, 2) < '24' THEN substr(stamp, 12, 5) END AS clock
FROM (SELECT *, (c_custkey % 7) * 0.125 AS lat, -(c_custkey % 5) * 0.25 AS lon, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS city,
  '2025:01:02 ' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') || ':15:00' AS stamp FROM customer) c JOIN nation ON n_nationkey = c_nationkey"""
)
def places_and_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    lat, lon = (F.col("c_custkey") % 7).cast("double") * 0.125, -(F.col("c_custkey") % 5).cast("double") * 0.25
    city = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))
    stamp = F.concat(F.lit("2025:01:02 "), F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"), F.lit(":15:00"))
    return c.select(
        "c_custkey", C.cell_key(lat, lon).alias("cell"), C.place_name(city, F.col("c_mktsegment"), F.col("n_name")).alias("place"), C.camera_clock(stamp).alias("clock")
    )


@_query(
    """SELECT id, line FROM (SELECT id, nullif(trim(string_split(caption, chr(10))[1]), '') AS line FROM (
  SELECT id, caption FROM images WHERE status = 'posted' ORDER BY loaded_at DESC, id LIMIT 40)) WHERE line IS NOT NULL"""
)
def recent_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of the 40 newest captions; empty ones are dropped after the limit."""
    newest = table(spark, sf_dir, "images").where("status = 'posted'").orderBy(F.col("loaded_at").desc(), "id").limit(40)
    return newest.select("id", T.first_line(F.col("caption")).alias("line")).where("line is not null")


@_query("SELECT doc_id, (SELECT max(doc_id) FROM documents) // 100 - doc_id // 100 AS page, 99 - doc_id % 100 AS place FROM documents")
def reverse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 100 read from the last one backwards, each backwards."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    last = docs.agg(F.max("doc_id")).scalar()
    return docs.select("doc_id", F.expr("doc_id div 100").alias("p"), (99 - F.col("doc_id") % 100).alias("place")).withColumn("page", F.floor(last / 100) - F.col("p")).drop("p")


@_query(
    """SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN CAST(round(value) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drift
FROM events"""
)
def learned_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last hit before each row, 0 before the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("event_type") != "error", F.round("value").cast("bigint"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.last(hit, True).over(w), F.lit(0)).alias("drift"))


@_query("SELECT coalesce(user_id, -1) AS user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY ROLLUP (user_id)")
def ok_fail_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    by = table(spark, sf_dir, "events").rollup("user_id").agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("ok"))
    return by.na.fill({"user_id": -1})


@_query(
    """WITH gone AS (SELECT id FROM images WHERE status = 'posted' AND id % 31 = 0)
SELECT asset_id, max(CASE WHEN asset_id IN (SELECT trim(asset_id) FROM images WHERE id IN (SELECT id FROM gone) AND asset_id IS NOT NULL) THEN 0 ELSE seen END) AS seen FROM asset_index GROUP BY 1 HAVING max(coalesce(seen, -1)) >= 0"""
)
def requeue_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with the assets of deleted posts open again."""
    gone = table(spark, sf_dir, "images").where("status = 'posted' and id % 31 = 0").select(F.trim("asset_id").alias("asset_id")).where("asset_id is not null").distinct()
    ledger = table(spark, sf_dir, "asset_index").select("asset_id", "seen").where("seen is not null")
    opened = state.update_given(ledger, gone.withColumn("seen", F.lit(0)), "asset_id")
    return opened.groupBy("asset_id").agg(F.max("seen").alias("seen"))


@_query("SELECT asset_id, list(lang ORDER BY first, lang) AS langs FROM (SELECT asset_id, lang, min(doc_id) AS first FROM documents WHERE asset_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").where("asset_id is not null and lang is not null").groupBy("asset_id", "lang").agg(F.min("doc_id").alias("first"))
    by = first.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("first", "lang"))).alias("l"))
    return by.select("asset_id", F.transform("l", lambda x: x["lang"]).alias("langs"))


@_query(
    """SELECT date, CAST(sum(ai) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS ai_7 FROM (
  SELECT d.date, coalesce(sum(ai_calls), 0) AS ai FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM run_stats), (SELECT max(date) FROM run_stats), INTERVAL 1 DAY)) AS DATE) AS date) d
  LEFT JOIN run_stats r ON r.date = d.date GROUP BY 1)"""
)
def whole_fleet_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "run_stats").groupBy("date").agg(F.coalesce(F.sum("ai_calls"), F.lit(0)).alias("ai"))
    out = trailing(days.withColumn("all", F.lit("all")), "all", "date", (7,), (Measure("ai", "ai"),))
    return out.select("date", "ai_7")


@_query(
    """SELECT l_orderkey, l_linenumber, round(area, 2) AS area FROM (
  SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_extendedprice DESC, l_linenumber) AS rn
  FROM lineitem) WHERE rn = 1"""
)
def largest_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each order with the largest product of its two sides, the first of equals."""
    area = (F.col("l_quantity") * F.col("l_extendedprice")).alias("area")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", area)
    best = lines.groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "area"), F.struct("area", -F.col("l_linenumber"))).alias("b"))
    return best.select("l_orderkey", "b.l_linenumber", F.round("b.area", 2).alias("area"))


@_query("SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda f: starts_with(f, 're'))) > 0 AS flagged FROM part")
def flagged_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any flag of a list starts with a prefix."""
    return table(spark, sf_dir, "part").select("p_partkey", F.exists(F.split("p_name", " "), lambda f: F.startswith(f, F.lit("re"))).alias("flagged"))


@_query("SELECT id, caption, CASE WHEN batch_no >= 20 THEN alt_text END AS alt_text, CASE WHEN batch_no >= 20 THEN coalesce(post_attempts, 0) ELSE 0 END AS post_attempts FROM images WHERE batch_no IS NOT NULL")
def added_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from before two columns were added beside rows that have them; counters default to 0."""
    images = table(spark, sf_dir, "images").where("batch_no is not null")
    old = images.where("batch_no < 20").select("id", "caption")
    new = images.where("batch_no >= 20").select("id", "caption", "alt_text", "post_attempts")
    return old.unionByName(new, allowMissingColumns=True).na.fill({"post_attempts": 0})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
