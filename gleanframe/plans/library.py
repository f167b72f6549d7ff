"""Queries for scans, state changes, predicates, orders and small scalars, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.functions import external as E
from gleanframe.functions import scalars as C
from gleanframe.functions.keys import real_key
from gleanframe.functions.timestamps import with_instant
from gleanframe.operators import lookup, sequence, state
from gleanframe.session import scratch_path
from gleanframe.sources import table
from gleanframe.sources.reports import append_report, markdown_lines, read_report

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def _key(c: str) -> str:
    return f"nullif(nullif(trim({c}, {_BLANKS}), ''), 'DRYRUN')"


def _at(text: str):
    return F.expr(f"timestamp_ntz'{text}'")


# ---- scans
@_query(
    """SELECT 'recent' AS scan, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'
UNION ALL SELECT 'fallback', event_id FROM events"""
)
def recent_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent rows, or all where there are none: once with a limit that some rows pass and once with one that none passes."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    some = sequence.or_else(rows.where(F.col("ts") >= _at("2024-01-15")), rows).select(F.lit("recent").alias("scan"), "event_id")
    none = sequence.or_else(rows.where(F.col("ts") >= _at("2999-01-01")), rows).select(F.lit("fallback").alias("scan"), "event_id")
    return some.unionByName(none)


@_query(
    """WITH stored AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS stored FROM orders WHERE o_orderstatus <> 'P'),
actual AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS actual FROM orders WHERE o_orderpriority <> '5-LOW'),
r AS (SELECT o_orderkey, stored, actual, actual - stored AS drift FROM stored LEFT JOIN actual USING (o_orderkey)),
g AS (SELECT *, coalesce(last_value(drift IGNORE NULLS) OVER (ORDER BY stored ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS learned,
  count(drift) OVER (ORDER BY stored) AS island FROM r),
s AS (SELECT *, CASE WHEN drift IS NULL THEN row_number() OVER (PARTITION BY island, drift IS NULL ORDER BY stored) ELSE 0 END AS misses FROM g)
SELECT o_orderkey, CASE WHEN drift IS NULL AND misses > 3 THEN 'kept' WHEN drift IS NULL THEN 'gone'
  WHEN abs(drift - learned) <= 60 THEN 'near' WHEN abs(drift - learned) <= 350 THEN 'wide' ELSE 'far' END AS found, learned, misses FROM s"""
)
def positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a stored position still leads: within a window of 120 around it and the last learned drift, one of 700, or not at all; long runs of misses are no deletions."""
    orders = table(spark, sf_dir, "orders")
    placed = lambda df, name: sequence.positions(df, [F.col("o_orderdate"), F.col("o_orderkey")], name)
    stored = placed(orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate"), "stored").select("o_orderkey", "stored")
    actual = placed(orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderdate"), "actual").select("o_orderkey", "actual")
    return sequence.positional(stored, actual, "o_orderkey", windows=(120, 700), most_misses=3)


_LEDGER = f"SELECT DISTINCT {_key('asset_id')} AS asset_id FROM asset_index WHERE seen = 1 AND {_key('asset_id')} IS NOT NULL"


@_query(
    f"""WITH p AS (SELECT {_key("asset_id")} AS asset_id, min(loaded_at) AS loaded_at, min(batch_no) AS batch_no FROM images GROUP BY 1 HAVING {_key("asset_id")} IS NOT NULL),
recent AS (SELECT asset_id, 1 AS phase, loaded_at FROM p WHERE loaded_at >= TIMESTAMP '2026-01-01' AND batch_no >= 10),
later AS (SELECT asset_id, 2 AS phase, loaded_at FROM p WHERE asset_id NOT IN (SELECT asset_id FROM recent) AND asset_id NOT IN ({_LEDGER}))
SELECT asset_id, phase FROM (SELECT * FROM recent UNION ALL SELECT * FROM later)"""
)
def chronological_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent assets first (archive batches skipped), then undecided ones that were not among them, newest first."""
    rows = table(spark, sf_dir, "images").select(real_key(F.col("asset_id")).alias("asset_id"), "loaded_at", "batch_no").where("asset_id is not null")
    rows = rows.groupBy("asset_id").agg(F.min("loaded_at").alias("loaded_at"), F.min("batch_no").alias("batch_no"))
    ledger = table(spark, sf_dir, "asset_index").select(real_key(F.col("asset_id")).alias("asset_id"), "seen")
    recent = rows.where((F.col("loaded_at") >= _at("2026-01-01")) & (F.col("batch_no") >= 10))
    later = lookup.undecided(state.without(rows, recent, "asset_id"), ledger, "asset_id", F.col("seen") == 1)
    both = recent.withColumn("phase", F.lit(1)).unionByName(later.withColumn("phase", F.lit(2)))
    return both.orderBy("phase", F.desc("loaded_at"), "asset_id").select("asset_id", "phase")


@_query(
    f"""SELECT doc_id, coalesce({_key("asset_id")} IN (SELECT {_key("asset_id")} FROM images WHERE status = 'rejected' AND {_key("asset_id")} IS NOT NULL), false) AS member FROM documents"""
)
def member_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a set of ids, told by the ids alone; a null id is no member, an empty set has none."""
    ids = table(spark, sf_dir, "images").where("status = 'rejected'").select(real_key(F.col("asset_id")).alias("asset_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", real_key(F.col("asset_id")).alias("asset_id"))
    return lookup.membership(docs, ids, "asset_id", "member").select("doc_id", "member")


@_query(
    """SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-03') ORDER BY ts DESC, event_id LIMIT 20"""
)
def newest_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 rows of users outside a set."""
    rows = table(spark, sf_dir, "events")
    rows = state.without(rows, rows.where((F.col("event_type") == "signup") & (F.col("ts") < _at("2024-01-03"))), "user_id")
    return rows.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id")


@_query(
    f"""WITH ids AS (SELECT id, {_key("tweet_id")} AS post, (row_number() OVER (ORDER BY id) - 1) // 100 AS request FROM images WHERE status = 'posted'),
m AS (SELECT {_key("tweet_id")} AS post, max(impressions) AS best FROM tweet_metrics GROUP BY 1)
SELECT request, count(*) AS asked, count(m.post) AS live, count(*) - count(m.post) AS gone, CAST(coalesce(sum(best), 0) AS BIGINT) AS reach
FROM ids LEFT JOIN m ON m.post = ids.post GROUP BY 1"""
)
def lookup_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted records looked up in requests of 100 ids: how many live, how many gone, the measures of the live ones."""
    ids = table(spark, sf_dir, "images").where("status = 'posted'").select("id", real_key(F.col("tweet_id")).alias("post"))
    ids = sequence.positions(ids, [F.col("id")], "place").withColumn("request", F.floor((F.col("place") - 1) / 100))
    best = table(spark, sf_dir, "tweet_metrics").groupBy(real_key(F.col("tweet_id")).alias("post")).agg(F.max("impressions").alias("best")).where("post is not null")
    found = ids.join(best.withColumn("there", F.lit(1)), "post", "left")
    return found.groupBy("request").agg(
        F.count("*").alias("asked"), F.count("there").alias("live"), F.count_if(F.col("there").isNull()).alias("gone"), F.coalesce(F.sum("best"), F.lit(0)).alias("reach")
    )


@_query(
    f"""SELECT id FROM images i WHERE i.id IN (SELECT id FROM images WHERE status = 'posted' AND phash IS NOT NULL ORDER BY loaded_at DESC, id LIMIT 50)
AND {_key("asset_id")} IN (SELECT {_key("asset_id")} FROM documents WHERE {_key("asset_id")} IS NOT NULL)"""
)
def recent_with_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 50 newest posted records with a fingerprint, those that a document is about."""
    recent = table(spark, sf_dir, "images").where("status = 'posted' and phash is not null").orderBy(F.desc("loaded_at"), "id").limit(50)
    there = table(spark, sf_dir, "documents").select(real_key(F.col("asset_id")).alias("asset_id"))
    return recent.select("id", real_key(F.col("asset_id")).alias("asset_id")).join(there, "asset_id", "left_semi").select("id")


# ---- mutations
@_query(
    f"""WITH b AS (SELECT * FROM (SELECT {_key("asset_id")} AS asset_id, reject_reason, row_number() OVER (PARTITION BY {_key("asset_id")} ORDER BY id DESC) AS rn FROM images) WHERE rn = 1 AND asset_id IS NOT NULL),
l AS (SELECT * FROM (SELECT {_key("asset_id")} AS asset_id, seen, retire_reason, attempts, row_number() OVER (PARTITION BY {_key("asset_id")} ORDER BY loaded_at DESC, decided_at DESC) AS rn FROM asset_index) WHERE rn = 1 AND asset_id IS NOT NULL)
SELECT 'ledger' AS side, coalesce(l.asset_id, b.asset_id) AS key, CASE WHEN b.asset_id IS NOT NULL THEN 1 ELSE l.seen END AS seen FROM l FULL JOIN b ON l.asset_id = b.asset_id
UNION ALL SELECT DISTINCT 'winners', lower(sha256), 1 FROM images"""
)
def committed_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A burst's decisions and its winners committed as one version of two tables, read back."""
    images = table(spark, sf_dir, "images")
    ledger = table(spark, sf_dir, "asset_index").select(real_key(F.col("asset_id")).alias("asset_id"), "seen", "retire_reason", "attempts", "loaded_at", "decided_at")
    ledger = state.last_per_key(ledger.where("asset_id is not null"), "asset_id", [F.col("loaded_at"), F.col("decided_at")]).select("asset_id", "seen", "retire_reason", "attempts")
    burst = images.select(real_key(F.col("asset_id")).alias("asset_id"), "id", F.lit(1).alias("seen"), F.col("reject_reason").alias("retire_reason")).where("asset_id is not null")
    burst = state.last_per_key(burst, "asset_id", [F.col("id")]).drop("id")
    winners = images.select(F.lower("sha256").alias("sha"), "id")
    store = state.VersionedTables(spark, scratch_path(spark, "burst"), ("ledger", "winners"))
    store.commit({"ledger": ledger, "winners": winners.limit(0)})
    now = store.read()
    got = store.commit({
        "ledger": state.upsert(now["ledger"], burst, "asset_id", ["seen", "retire_reason"]),
        "winners": state.insert_ignore(now["winners"], winners, "sha", [F.col("id")]),
    })
    sides = [got["ledger"].select(F.lit("ledger").alias("side"), F.col("asset_id").alias("key"), "seen"), got["winners"].select(F.lit("winners").alias("side"), F.col("sha").alias("key"), F.lit(1).alias("seen"))]
    return sides[0].unionByName(sides[1])


@_query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_brand END AS p_brand, CASE WHEN p_size > 40 THEN '["' || p_brand || '","' || p_name || '"]' ELSE p_type END AS p_type, p_name FROM part""")
def update_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial update that takes only listed columns and writes lists as JSON; ``p_name`` is not on the list."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    given = part.where("p_size > 40").select("p_partkey", F.lit("big").alias("p_brand"), F.array("p_brand", "p_name").alias("p_type"), F.lit("no").alias("p_name"))
    return state.update_given(part, given, "p_partkey", allowed=["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type", "p_name")


@_query(
    """SELECT 'reset' AS change, count(*) FILTER (WHERE status = 'posting') AS n FROM images
UNION ALL SELECT 'purged', count(*) FILTER (WHERE status IN ('queued', 'approved', 'seen')) FROM images"""
)
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a bulk reset and a purge change, told by comparing the states before and after."""
    before = table(spark, sf_dir, "images").select("id", "status")
    reset = state.changed_rows(before, state.moved(before, "status", "posting", "approved"), "id").agg(F.count("*").alias("n"))
    purged = state.changed_rows(before, before.where(~F.col("status").isin("queued", "approved", "seen") | F.col("status").isNull()), "id").agg(F.count("*").alias("n"))
    return reset.select(F.lit("reset").alias("change"), "n").unionByName(purged.select(F.lit("purged").alias("change"), "n"))


@_query(
    """SELECT runner, date, ai_calls FROM run_stats WHERE date = DATE '2025-06-01'
UNION ALL SELECT DISTINCT runner, DATE '2025-06-01', 0 FROM run_stats WHERE runner NOT IN (SELECT runner FROM run_stats WHERE date = DATE '2025-06-01' AND runner IS NOT NULL)"""
)
def ensured_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every runner has a row for the day: the one it has, or zeros."""
    rows = table(spark, sf_dir, "run_stats").select("runner", "date", "ai_calls")
    today = rows.where("date = date'2025-06-01'")
    zeros = rows.select("runner").distinct().select("runner", F.lit("2025-06-01").cast("date").alias("date"), F.lit(0).cast("bigint").alias("ai_calls"))
    return state.ensured(today, zeros, "runner")


@_query(
    f"""WITH gone AS (SELECT {_key("asset_id")} AS asset_id FROM asset_index GROUP BY 1 HAVING {_key("asset_id")} IS NOT NULL AND count(*) = count(deleted_at))
SELECT 'images' AS side, CAST(id AS VARCHAR) AS key, 0 AS seen FROM images WHERE {_key("asset_id")} IS NULL OR {_key("asset_id")} NOT IN (SELECT asset_id FROM gone)
UNION ALL SELECT 'ledger', asset_id, CASE WHEN {_key("asset_id")} IN (SELECT asset_id FROM gone) THEN 0 ELSE seen END FROM asset_index"""
)
def requeued_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted assets requeued: their pictures are removed and the ledger's mark is cleared."""
    ledger, images = table(spark, sf_dir, "asset_index"), table(spark, sf_dir, "images")
    keyed = real_key(F.col("asset_id"))
    gone = ledger.groupBy(keyed.alias("k")).agg((F.count("*") == F.count("deleted_at")).alias("all_gone")).where("k is not null and all_gone").select("k")
    left = state.without(images.select("id", keyed.alias("k")), gone, "k").select(F.lit("images").alias("side"), F.col("id").cast("string").alias("key"), F.lit(0).alias("seen"))
    cleared = lookup.membership(ledger.withColumn("k", keyed), gone, "k", "__gone")
    return left.unionByName(cleared.select(F.lit("ledger").alias("side"), F.col("asset_id").alias("key"), F.when(F.col("__gone"), 0).otherwise(F.col("seen")).alias("seen")))


@_query(
    f"""WITH dead AS (SELECT DISTINCT {_key("tweet_id")} AS post FROM images WHERE {_key("tweet_id")} NOT IN (SELECT {_key("tweet_id")} FROM tweet_metrics WHERE {_key("tweet_id")} IS NOT NULL)),
hit AS (SELECT DISTINCT {_key("asset_id")} AS asset_id FROM images WHERE {_key("tweet_id")} IN (SELECT post FROM dead) AND {_key("asset_id")} IS NOT NULL)
SELECT 'images' AS side, CAST(id AS VARCHAR) AS key, CASE WHEN {_key("tweet_id")} IN (SELECT post FROM dead) THEN 'rejected' ELSE status END AS state FROM images
UNION ALL SELECT 'ledger', asset_id, CASE WHEN {_key("asset_id")} IN (SELECT asset_id FROM hit) THEN '1' ELSE CAST(seen AS VARCHAR) END FROM asset_index"""
)
def retired_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without a reading retired: the picture is rejected and the ledger's row marked as seen."""
    images = table(spark, sf_dir, "images").select("id", "status", real_key(F.col("tweet_id")).alias("post"), real_key(F.col("asset_id")).alias("k"))
    live = table(spark, sf_dir, "tweet_metrics").select(real_key(F.col("tweet_id")).alias("post"))
    dead = state.without(images.where("post is not null").select("post"), live, "post").distinct()
    hit = images.join(dead, "post", "left_semi").select("k")
    pictures = lookup.membership(images, dead, "post", "__dead").select(F.lit("images").alias("side"), F.col("id").cast("string").alias("key"), F.when(F.col("__dead"), "rejected").otherwise(F.col("status")).alias("state"))
    ledger = lookup.membership(table(spark, sf_dir, "asset_index").withColumn("k", real_key(F.col("asset_id"))), hit, "k", "__hit")
    return pictures.unionByName(ledger.select(F.lit("ledger").alias("side"), F.col("asset_id").alias("key"), F.when(F.col("__hit"), "1").otherwise(F.col("seen").cast("string")).alias("state")))


@_query(
    """SELECT 'last_posted_at' AS key, coalesce(strftime(max(loaded_at) FILTER (WHERE status = 'posted'), '%Y-%m-%d %H:%M:%S'), '') AS value FROM images
UNION ALL SELECT 'kept', 'x'"""
)
def recomputed_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest time of posted rows, or an empty text, put into a key-value table that keeps its other keys."""
    settings = spark.createDataFrame([("last_posted_at", "old"), ("kept", "x")], "key string, value string")
    latest = table(spark, sf_dir, "images").where("status = 'posted'").agg(F.coalesce(F.date_format(F.max("loaded_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("value"))
    return state.upsert(settings, latest.select(F.lit("last_posted_at").alias("key"), "value"), "key", ["value"])


# ---- predicates
@_query("SELECT l_orderkey, l_linenumber, coalesce(l_shipdate - o_orderdate > INTERVAL 30 DAY, false) AS late FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'")
def late_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrived more than 30 days after they were made; without one of the times not late."""
    made = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").join(made, "l_orderkey", "left")
    return rows.select("l_orderkey", "l_linenumber", C.much_later(F.col("l_shipdate"), F.col("o_orderdate"), 30).alias("late"))


@_query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount >= 0.08 THEN 'discount' WHEN l_quantity < 10 THEN 'small' ELSE 'pass' END AS label FROM lineitem"""
)
def first_failing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the first check, in order, that a row fails; an undecided check does not fail."""
    checks = {"returned": F.col("l_returnflag") == "R", "discount": F.col("l_discount") >= 0.08, "small": F.col("l_quantity") < 10}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.first_true(checks, "pass").alias("label"))


@_query(
    """WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, (hour(ts + INTERVAL 8 HOUR) * 60 + minute(ts)) AS m FROM events)
SELECT event_id, (m >= 1320 OR m < 540) AND (before IS NULL OR epoch_us(ts) - epoch_us(before) >= 21600000000) AS due FROM e"""
)
def due_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row falls into the daily window (past midnight, on a clock of UTC+8) and six hours after its user's last."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").withColumn("before", F.lag("ts").over(w))
    return rows.select("event_id", (C.in_window(C.local_minute(F.col("ts")), 1320, 540) & C.due(F.col("ts"), F.col("before"), 6 * 3600)).alias("due"))


@_query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last seven days before the newest."""
    rows = table(spark, sf_dir, "events")
    return rows.where(F.col("ts") > rows.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar()).select("event_id")


@_query("SELECT doc_id, NOT coalesce(regexp_matches(text, '[0-9]'), false) OR source IS NULL AS shut FROM documents")
def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that holds unless its evidence is there: missing or unreadable evidence counts against the row."""
    evidence = F.col("text").rlike("[0-9]") & F.col("source").isNotNull()
    return table(spark, sf_dir, "documents").select("doc_id", C.unless(evidence).alias("shut"))


# ---- joins with settings
@_query("SELECT o_orderkey, m.name AS model, o_totalprice * m.rate AS value FROM orders, (VALUES ('a', 1), ('b', 2), ('c', 4)) m(name, rate)")
def settings_times_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once per setting, by unfolding a literal list in place; no join."""
    settings = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(r).alias("rate")) for n, r in (("a", 1), ("b", 2), ("c", 4))])
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.inline(settings)).select("o_orderkey", "model", (F.col("o_totalprice") * F.col("rate")).alias("value"))


# ---- aggregates
_LATEST = f"""WITH latest AS (SELECT * FROM (SELECT {_key("tweet_id")} AS post, coalesce(impressions, 0) AS seen,
  row_number() OVER (PARTITION BY {_key("tweet_id")} ORDER BY loaded_at DESC, metric_id DESC) AS rn FROM tweet_metrics) WHERE rn = 1 AND post IS NOT NULL)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "tweet_metrics").select(real_key(F.col("tweet_id")).alias("post"), F.coalesce("impressions", F.lit(0)).alias("seen"), "loaded_at", "metric_id")
    return lookup.latest_per_key(m.where("post is not null"), "post", [F.col("loaded_at"), F.col("metric_id")])


@_query()
def median_by_posting_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median reach and posts by the hour (UTC+8) at which they were posted; posts without a readable time are left out."""
    posts = table(spark, sf_dir, "images").select(real_key(F.col("tweet_id")).alias("post"), "posted_at", "wall_zone").where("post is not null")
    posts = with_instant(posts, "posted_at", "wall_zone", "us").groupBy("post").agg(F.min("us").alias("us")).where("us is not null")
    hour = F.pmod(F.floor(F.col("us") / 3_600_000_000) + 8, F.lit(24)).cast("int")
    rows = posts.join(_latest(spark, sf_dir), "post")
    return lookup.exact_median(rows.withColumn("hour", hour), ["hour"], "seen").orderBy("hour")


@_query(_LATEST + " SELECT count(*) AS n, coalesce(median(seen), 0.0) AS median FROM latest WHERE seen < -100")
def median_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of no rows at all is 0."""
    return _latest(spark, sf_dir).where("seen < -100").agg(F.count("*").alias("n"), F.coalesce(F.median("seen"), F.lit(0.0)).alias("median"))


_ARMS = _LATEST + f""", c AS (SELECT {_key("tweet_id")} AS post, min(caption) AS caption FROM images GROUP BY 1),
r AS (SELECT 'hash' AS test, coalesce(contains(caption, '#'), false) AS arm, seen FROM c JOIN latest USING (post)
  UNION ALL SELECT 'never', coalesce(contains(caption, chr(1)), false), seen FROM c JOIN latest USING (post))
SELECT test, arm, count(*) AS n, median(seen) AS median, count(*) < 10 AS few FROM r WHERE test IN (SELECT test FROM r GROUP BY 1 HAVING count(DISTINCT arm) = 2) GROUP BY 1, 2"""


@_query(_ARMS)
def tests_with_both_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two arms, only for tests of which both arms have rows; few rows are pointed out."""
    c = table(spark, sf_dir, "images").select(real_key(F.col("tweet_id")).alias("post"), "caption").where("post is not null").groupBy("post").agg(F.min("caption").alias("caption"))
    has = lambda x: F.coalesce(F.contains("caption", F.lit(x)), F.lit(False))
    arms = F.array(F.struct(F.lit("hash").alias("test"), has("#").alias("arm")), F.struct(F.lit("never").alias("test"), has("\x01").alias("arm")))
    by = lookup.exact_median(c.join(_latest(spark, sf_dir), "post").select("seen", F.inline(arms)), ["test", "arm"], "seen")
    both = F.count("*").over(Window.partitionBy("test")) == 2  # a row per arm
    return by.withColumn("__both", both).where("__both").select("test", "arm", "n", "median", (F.col("n") < 10).alias("few"))


@_query("SELECT event_type, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths, CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS slowest FROM events GROUP BY 1")
def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and summed times per kind, in whole hundredths, so that the order of the rows does not matter."""
    t = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(t).alias("hundredths"), F.max(t).alias("slowest"))


@_query(
    """WITH u AS (SELECT l_shipmode_ AS unit, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM
  (SELECT l_returnflag AS l_shipmode_, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b FROM lineitem) GROUP BY 1),
p AS (SELECT unit, a * CASE unit WHEN 'A' THEN 30001 WHEN 'N' THEN 1499 ELSE 0 END + b * CASE unit WHEN 'A' THEN 60007 WHEN 'N' THEN 7 ELSE 0 END AS parts FROM u)
SELECT unit, round(parts / 1e9, 6) AS cost FROM p UNION ALL SELECT 'total', round(sum(parts) / 1e9, 6) FROM p"""
)
def two_rate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two amounts per unit times two rates (a missing unit has rates 0), and the total rounded from unrounded parts."""
    rates = spark.createDataFrame([("A", 30001, 60007), ("N", 1499, 7)], "unit string, ra bigint, rb bigint")
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("unit")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("a"), F.sum("l_linenumber").alias("b"))
    used = lookup.with_default(used, rates, "unit", {"ra": 0, "rb": 0}).withColumn("parts", F.col("a") * F.col("ra") + F.col("b") * F.col("rb"))
    total = used.agg(F.sum("parts").alias("parts")).select(F.lit("total").alias("unit"), "parts")
    return used.select("unit", "parts").unionByName(total).select("unit", F.round(F.col("parts") / 1e9, 6).alias("cost"))


@_query(
    """WITH w AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part),
c AS (SELECT p_brand, right(p_name, 1) AS last, count(*) AS n, min(p_partkey) AS first FROM w WHERE place > 1 GROUP BY 1, 2)
SELECT p_brand, last FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1"""
)
def consensus_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent last character among a group's rows other than the winner; of equally frequent ones the first seen."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.right("p_name", F.lit(1)).alias("last"), "p_retailprice")
    best = rows.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("winner"))
    others = rows.join(best, "p_brand").where("p_partkey <> winner").groupBy("p_brand", "last").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return others.groupBy("p_brand").agg(F.max_by("last", F.struct("n", -F.col("first"))).alias("last"))


@_query(
    """SELECT l_orderkey, l_tax AS best, l_quantity AS area FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1"""
)
def best_with_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value of a group together with another measure of the same row; the first of equal rows."""
    order = F.struct("l_tax", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_quantity"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by(F.struct("l_tax", "l_quantity"), order).alias("b"))
    return by.select("l_orderkey", F.col("b.l_tax").alias("best"), F.col("b.l_quantity").alias("area"))


# ---- orders, lists, sequences
@_query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a customer's orders, newest first, ties by key."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@_query(
    """SELECT l_orderkey, array_to_string(list_concat(coalesce(list_sort(list(l_partkey) FILTER (WHERE l_returnflag = 'A')), []), coalesce(list_sort(list(l_partkey) FILTER (WHERE l_returnflag = 'R')), []))[1:8], ',') AS parts FROM lineitem GROUP BY 1"""
)
def lists_joined_and_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and further rows of a group as one list, of which the first eight are shown."""
    some = lambda flag: F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_partkey"))))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(some("A").alias("a"), some("R").alias("r"))
    return by.select("l_orderkey", F.array_join(F.slice(F.concat("a", "r"), 1, 8), ",").alias("parts"))


@_query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1")
def first_error_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error per key, the first."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id")
    return state.first_per_key(errors, "user_id", [F.col("event_id")])


@_query(
    """WITH c AS (SELECT *, coalesce(sum(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS ord FROM orders)
SELECT o_custkey, min(ord) FILTER (WHERE o_totalprice > 300000 AND spent < 12) AS winner, count(*) FILTER (WHERE spent < 12) AS affordable FROM c GROUP BY 1"""
)
def walk_back_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passing row of each walk whose cost so far is below the budget, and how many rows the budget reaches."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({
        "ord": F.row_number().over(w), "spent": F.coalesce(F.sum(F.col("o_orderkey") % 7).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    reached = F.col("spent") < 12
    return rows.groupBy("o_custkey").agg(F.min(F.when(reached & (F.col("o_totalprice") > 300000), F.col("ord"))).alias("winner"), F.count_if(reached).alias("affordable"))


# ---- small scalars
@_query(
    r"""SELECT doc_id, left(text, 200) AS cut, CASE WHEN text IS NULL OR regexp_matches(text, '🏮\s*$') THEN text ELSE rtrim(text) || ' 🏮' END AS marked,
  coalesce(n_chars, -1) = coalesce(length(text), -1) AS agree, CASE WHEN n_chars BETWEEN 0 AND 99 THEN n_chars ELSE 0 END AS pick FROM documents"""
)
def caption_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of 200 characters, a mark put behind texts that do not end with it, agreement with defaults, an index that is 0 when out of range."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.left(t, F.lit(200)).alias("cut"), C.marked(t, F.lit("🏮")).alias("marked"),
        C.agree(F.col("n_chars"), F.length(t), -1).alias("agree"), C.index_or_zero(F.col("n_chars"), F.lit(100)).alias("pick"),
    )


@_query(
    """SELECT p_partkey, CASE p_size % 10 WHEN 2 THEN 'mirror' WHEN 3 THEN 'turn180' WHEN 4 THEN 'flip' WHEN 5 THEN 'transpose' WHEN 6 THEN 'turn270' WHEN 7 THEN 'transverse' WHEN 8 THEN 'turn90' ELSE 'none' END AS turn,
  CASE WHEN p_retailprice / 1000 >= 0.95 AND p_size / 50.0 >= 0.3 THEN 'main' WHEN p_retailprice / 1000 >= 0.95 THEN 'small' ELSE 'other' END AS prominence,
  array_to_string(list_slice(string_split(p_name || ' ' || p_type || ' a b c d e f', ' '), 1, 6), '|') AS flags, left(p_type, 4) AS reason,
  lower(trim(p_brand)) IN ('1', 'true', 'yes') AS truth, p_brand || ': ' || p_size || ' used' AS line,
  sha256('0=' || p_name || chr(0) || '1=' || p_brand || chr(0)) AS key FROM part"""
)
def part_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation codes, a decision by two measures, clipped lists and texts, flags, formatted lines, content keys."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.orientation(F.col("p_size") % 10).alias("turn"),
        C.prominence(F.col("p_retailprice") / 1000, F.col("p_size") / 50.0, 0.95, 0.3).alias("prominence"),
        F.array_join(F.slice(F.split(F.concat_ws(" ", "p_name", "p_type", F.lit("a b c d e f")), " "), 1, 6), "|").alias("flags"), F.left("p_type", F.lit(4)).alias("reason"),
        C.truth(F.col("p_brand")).alias("truth"), F.format_string("%s: %d used", "p_brand", "p_size").alias("line"), C.content_key(F.col("p_name"), F.col("p_brand")).alias("key"),
    )


@_query(
    """SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN greatest(0, least(10, event_id % 17 - 3)) ELSE 0 END AS INTEGER) AS quality, greatest(0, least(event_id % 9 - 2, 4)) AS clamped,
  CASE WHEN user_id * 100 <= 0 THEN 'now' ELSE CAST(user_id * 100 // 3600 AS VARCHAR) || 'h ' || lpad(CAST(user_id * 100 % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS wait FROM events"""
)
def event_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written score is cut to 0 .. 10 and 0 where it is no whole number, an index is moved into its range, seconds become a countdown."""
    return table(spark, sf_dir, "events").select(
        "event_id", C.score_0_10(F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 17 - 3).cast("string")).otherwise(F.col("value").cast("string"))).alias("quality"),
        C.clamped(F.col("event_id") % 9 - 2, F.lit(5)).alias("clamped"), C.countdown(F.col("user_id") * 100).alias("wait"),
    )


# ---- outside decisions, with clients that answer by rule
def _length_client() -> Callable[[list], list]:
    def call(batch: list) -> list:
        return [None if len(x) % 5 == 0 else {"safe": len(x) % 2 == 0, "interesting": True, "score": str(len(x) % 14), "best": len(x) % 9 - 2, "same": len(x) % 3 == 0, "yes": len(x) % 3 == 0} for x in batch]

    return call


_ANSWER = "safe boolean, interesting boolean, score string, best int, same boolean, yes boolean"


@_query(
    """WITH d AS (SELECT doc_id, length(text) AS n, text IS NOT NULL AND length(text) % 5 <> 0 AS ok FROM documents)
SELECT doc_id, coalesce(ok, false) AS ok, coalesce(ok AND n % 2 = 0, false) AS safe, CASE WHEN ok THEN least(10, n % 14) ELSE 0 END AS score,
  CASE WHEN ok THEN greatest(0, least(2, n % 9 - 2)) ELSE 0 END AS best, CASE WHEN ok THEN n % 3 = 0 ELSE false END AS open_scene, CASE WHEN ok THEN n % 3 = 0 ELSE true END AS closed_scene FROM d"""
)
def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's answers as verdicts: refusing where there is none, score and index kept in range, a scene check that is open or closed."""
    answer = E.decided(_length_client, F.col("text"), _ANSWER, {"safe": False}, attempts=1)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("answer", answer)
    v = E.group_verdict(F.col("answer"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = rows.withColumn("v", v)
    return rows.select(
        "doc_id", "v.ok", "v.safe", "v.score", "v.best",
        E.same_scene(F.col("answer"), False).alias("open_scene"), E.same_scene(F.col("answer"), True).alias("closed_scene"),
    )


@_query(
    """SELECT doc_id, CASE WHEN text IS NULL THEN true WHEN length(text) < 200 THEN false WHEN length(text) % 5 = 0 THEN true ELSE length(text) % 3 = 0 END AS owner FROM documents"""
)
def gate_before_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap check decides where it can; only the rest is asked, and lets pass without an answer."""
    gate = F.when(F.length("text") < 200, F.lit(False))
    return E.gate_then_ask(table(spark, sf_dir, "documents"), gate, F.col("text"), "owner", _length_client, "yes boolean", {"yes": True}).select("doc_id", "owner")


@_query(
    """SELECT p_partkey, CASE WHEN p_name = p_brand THEN p_name WHEN p_partkey % 5 < 3 THEN [p_name, p_brand, p_type][CAST(p_partkey % 5 AS INTEGER) + 1] ELSE p_name END AS pick FROM part"""
)
def picked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picker's candidate among distinct ones; an index out of range names the first."""
    candidates = F.array(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", E.picked(candidates, (F.col("p_partkey") % 5).cast("int")).alias("pick"))


@_query(
    """WITH t AS (SELECT p_partkey, p_name, unnest([0, 90, 180, 270]) AS turn FROM part), o AS (SELECT p_partkey, list(turn ORDER BY md5(p_name || '/' || turn)) AS turns FROM t GROUP BY 1)
SELECT p_partkey, array_to_string(turns, ',') AS turns, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 AND p_partkey % 2 = 0 THEN turns[CAST(p_partkey % 6 AS INTEGER)] ELSE 0 END AS chosen FROM o"""
)
def turns_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns in an order that follows from the name, and the one behind a confirmed pick."""
    name, key = F.col("p_name"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.transform(E.turn_order(name), lambda x: x.cast("string")), ",").alias("turns"), E.chosen_turn(name, (key % 6).cast("int"), key % 2 == 0).alias("chosen")
    )


@_query(
    """SELECT id, CASE WHEN phash IS NULL THEN 'rejected' WHEN post_attempts >= 2 THEN 'transient' WHEN caption IS NULL THEN 'rejected' ELSE 'approved' END AS state,
  CASE WHEN phash IS NULL THEN 'hash' WHEN post_attempts >= 2 THEN 'attempts' WHEN caption IS NULL THEN 'caption' END AS step FROM images"""
)
def preparation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered chain of steps that ends a row as rejected, transient or approved at the first that stops it."""
    steps = [("hash", F.col("phash").isNull(), "rejected"), ("attempts", F.col("post_attempts") >= 2, "transient"), ("caption", F.col("caption").isNull(), "rejected")]
    return table(spark, sf_dir, "images").withColumn("p", E.prepared(steps)).select("id", "p.state", "p.step")


# ---- sinks
@_query(
    """WITH g AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS best FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') || '/' || l_returnflag || '/' || CASE WHEN n = 1 THEN CAST(l_orderkey AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || CASE WHEN best = 1 THEN '-winner' ELSE '' END END AS path FROM g"""
)
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reviewed row is archived: by day and outcome, a single row as a file, several as a folder with the winner marked."""
    g = Window.partitionBy("l_orderkey")
    best = F.row_number().over(g.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"n": F.count("*").over(g), "best": best})
    name = F.when(F.col("n") == 1, F.col("l_orderkey").cast("string")).otherwise(F.concat_ws("", F.concat_ws("/", "l_orderkey", "l_linenumber"), F.when(F.col("best") == 1, "-winner")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("/", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag", name).alias("path"))


@_query("SELECT '| ' || event_type || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line FROM events GROUP BY event_type UNION ALL SELECT '| event_type | n |' UNION ALL SELECT '| --- | --- |'")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary appended to a text report and read back."""
    path = scratch_path(spark, "report")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    append_report(markdown_lines(counts, ["event_type", "n"], [F.col("event_type")]), path)
    return read_report(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
