import re

import pytest
from brute import instant, key

from gleanframe.operators import snapshots as S
from gleanframe.plans import dealt
from gleanframe.sources import table


def test_p1_against_brute_force(spark, tiny):
    best = {}
    for r in table(spark, tiny, "tweet_metrics").collect():
        if (k := key(r.tweet_id)) is None:
            continue
        t = instant(r.fetched_at, r.wall_zone)
        rank = (t is not None, t or 0, r.metric_id)
        if (r.snapshot_no, k) not in best or rank > best[r.snapshot_no, k][0]:
            best[r.snapshot_no, k] = (rank, r.impressions)
    present = sorted({r.snapshot_no for r in table(spark, tiny, "tweet_metrics").select("snapshot_no").distinct().collect()})
    want = set()
    for a, b in zip(present, present[1:], strict=False):
        old = {k: v[1] for (s, k), v in best.items() if s == a}
        new = {k: v[1] for (s, k), v in best.items() if s == b}
        want |= {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "removed") for k in old.keys() - new.keys()}
        want |= {(b, k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    got = dealt.p1_found(spark, tiny).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def _diff(spark, rows):
    df = spark.createDataFrame(rows, "s int, k string, v bigint, w string")
    order = S.snapshot_order(df, "s")
    index = S.NeighbourIndex(df.where("k <> 'none'"), order, "s", ["k"], ["v", "w"])
    found = sorted(tuple(r) for r in index.changes().collect())
    assert sorted(tuple(r)[:3] for r in index.changes_with_values().collect()) == found
    return found


def test_nulls_gaps_and_empty_snapshots(spark):
    rows = [(1, "a", 1, None), (1, "b", None, "x"), (1, "c", 5, "x"), (3, "a", 1, None), (3, "b", 0, "x"), (3, "d", 1, "y"), (4, "none", 0, ""), (7, "a", 1, None)]
    assert _diff(spark, rows) == [
        (3, "b", "changed"), (3, "c", "removed"), (3, "d", "added"),
        (4, "a", "removed"), (4, "b", "removed"), (4, "d", "removed"), (7, "a", "added"),
    ]
    assert _diff(spark, rows[:3]) == [] and _diff(spark, []) == []


def test_store_swaps_and_fetches_old_values(spark, tmp_path):
    store = S.SnapshotStore(spark, str(tmp_path / "t"), ["k"], ["v"], buckets=4)
    mk = lambda rows: spark.createDataFrame(rows, "k string, v bigint")
    assert store.apply(mk([("a", 1), ("b", 2), (None, 3)])).count() == 0
    got = store.apply(mk([("a", 1), ("b", None), ("c", 9), (None, 4)])).collect()
    assert sorted((r.k or "", r.change_kind, r.old_v, r.new_v) for r in got) == [("", "changed", 3, 4), ("b", "changed", 2, None), ("c", "added", None, 9)]
    got = store.apply(mk([])).collect()
    assert len(got) == 4 and {r.change_kind for r in got} == {"removed"}
    assert store.apply(mk([("a", 1)])).count() == 1


def test_hot_key_and_ties(spark):
    rows = [(1, "hot", 1, i) for i in range(500)] + [(1, "b", 7, 3), (1, "b", 9, 3)]
    df = spark.createDataFrame(rows, "s int, k string, v bigint, t bigint")
    got = S.latest_rows(df, ["s", "k"], [df.t, df.v], ["v", "t"]).collect()
    assert sorted((r.k, r.v, r.t) for r in got) == [("b", 9, 3), ("hot", 1, 499)]


@pytest.fixture
def unbroadcast(spark):
    """Plans as for tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_the_probe_reads_bucketed_indexes_in_place(spark, tiny, unbroadcast):
    """The written indexes are never exchanged, only the changes are where values are fetched; a probe reads keys and hashes only."""
    for query, values in ((dealt.p1_found, False), (dealt.p1_changes_with_values, True)):
        plan = query(spark, tiny)._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan parquet spark_catalog" in x]
        assert scans and all("Bucketed: true" in x for x in scans)
        assert len(re.findall(r"Exchange hashpartitioning\(snapshot_no#\d+, tweet_id", plan)) == int(values)
        assert not re.search(r"Exchange hashpartitioning.*\n[^\n]*(?:Project|Filter|ColumnarToRow)[^\n]*\n[^\n]*FileScan parquet spark_catalog", plan)
        assert any("impressions" in x for x in scans) == values


def test_changes_with_values_against_the_rows(spark, tiny):
    rows, _ = dealt._live_posts(spark, tiny)
    value = {(r.snapshot_no, r.tweet_id): r.impressions for r in rows.collect()}
    present = sorted({s for s, _ in value})
    before = dict(zip(present[1:], present, strict=False))
    got = dealt.p1_changes_with_values(spark, tiny).collect()
    assert got and all(r.new_impressions == value.get((r.snapshot_no, r.tweet_id)) and r.old_impressions == value.get((before[r.snapshot_no], r.tweet_id)) for r in got)


def test_neighbours_without_keys_are_no_records(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, None, 3), (None, "a", 4)], "s int, k string, v int")
    index = S.NeighbourIndex(df, S.snapshot_order(df, "s"), "s", ["k"], ["v"])
    assert [tuple(r) for r in index.changes().collect()] == [(2, "a", "removed")]


def test_store_probes_in_place(spark, tmp_path, monkeypatch, unbroadcast):
    plans = []
    fetched = S.fetched
    monkeypatch.setattr(S, "fetched", lambda *a: plans.append(fetched(*a)) or plans[-1])
    store = S.SnapshotStore(spark, str(tmp_path / "t"), ["k"], ["v"], buckets=4)
    for v in (1, 2):
        store.apply(spark.createDataFrame([("a", v), (None, v), ("b", 7)], "k string, v bigint"))
    assert plans[1]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
