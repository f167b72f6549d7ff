import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.llm import quantiles as Q
from gleanframe.llm.quantile_queries import SHARES, p6_percentiles
from gleanframe.sources import table


def _holds(s, i, values):
    """Every tuple's true rank range meets its interval, and the ends are the extremes."""
    a, b = s.offsets[i], s.offsets[i + 1]
    v, lo, hi = s.v[a:b], s.lo[a:b], s.hi[a:b]
    values = np.sort(values)
    first, last = np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")
    assert (lo <= hi).all() and (np.maximum(lo, first) <= np.minimum(hi, last)).all()
    assert v[0] == values[0] and v[-1] == values[-1] and s.n[i] == len(values)
    return v, lo, hi


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=120), min_size=1, max_size=6), st.sampled_from([0.01, 0.05, 0.2]))
def test_merging_keeps_proven_ranks(parts, eps):
    g = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    s = Q.Summaries.exact(g, np.concatenate(parts).astype(float)).compressed(eps / 2)
    for i, p in enumerate(parts):
        _holds(s, i, p)
    m = s.merged(np.zeros(len(parts), np.int64)).compressed(eps)
    every = np.concatenate(parts)
    v, lo, hi = _holds(m, 0, every)
    gap = (hi[1:] - lo[:-1]).max() if len(v) > 1 else 0
    assert gap <= max(2 * eps * len(every), len(parts) + 1)


@pytest.fixture()
def small_eps(monkeypatch):
    return 0.02


def _check(rows, values_of, key):
    for r in rows:
        values = np.sort(values_of(r))
        assert r.n == len(values)
        for name, p in SHARES.items():
            rank = max(1, int(np.ceil(p * r.n)))
            first, last = np.searchsorted(values, r[name], "left") + 1, np.searchsorted(values, r[name], "right")
            assert last >= first and max(0, first - rank, rank - last) <= r.rank_error, (r, name)


def test_large_groups_many_partitions(spark, small_eps):
    rng = np.random.default_rng(2)
    rows = [("hot", float(x)) for x in rng.lognormal(3, 2, 6000).round(1)] + [("b", 1.0)] * 700 + [(None, 5.0), ("e", None), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    m = Q.merge(Q.summarise(df, ["k"], F.col("v"), small_eps), ["k"], small_eps)
    got = Q.percentiles(m, ["k"], SHARES).collect()
    assert {r.k for r in got} == {"hot", "b", None}
    _check(got, lambda r: np.array([v for k, v in rows if k == r.k]), "k")
    hot = next(r for r in got if r.k == "hot")
    assert 0 < hot.rank_error <= np.ceil(small_eps * 6000)
    assert m.where("k = 'hot'").select(F.size("v")).collect()[0][0] < 400


def test_small_groups_are_exact_and_empty_is_empty(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2)], "k string, v int")
    r = Q.percentiles(Q.merge(Q.summarise(df, ["k"], F.col("v")), ["k"]), ["k"], {"p50": 0.5, "p1": 0.01}).collect()[0]
    assert (r.n, r.p50, r.p1, r.rank_error) == (3, 2.0, 1.0, 0)
    assert Q.merge(Q.summarise(df.limit(0), ["k"], F.col("v")), ["k"]).count() == 0


def test_p6_against_sorting(spark, tiny):
    from brute import instant, key

    posted = {}
    for r in table(spark, tiny, "images").collect():
        if (k := key(r.tweet_id)) and (t := instant(r.posted_at, r.wall_zone)) is not None:
            posted[k] = min(t, posted.get(k, t))
    values = {}
    for r in table(spark, tiny, "tweet_metrics").where("impressions >= 0").collect():
        values.setdefault((r.snapshot_no, "all", "all"), []).append(r.impressions)
        if (k := key(r.tweet_id)) in posted:
            at = np.datetime64(posted[k] + 8 * 3_600_000_000, "us")
            values.setdefault((r.snapshot_no, "hour", str(at)[11:13]), []).append(r.impressions)
            values.setdefault((r.snapshot_no, "day", str(at)[:10]), []).append(r.impressions)
    got = p6_percentiles(spark, tiny).collect()
    assert {(r.snapshot_no, r.period_kind, r.period) for r in got} == set(values) and len(got) == len(values)
    _check(got, lambda r: np.array(values[r.snapshot_no, r.period_kind, r.period]), None)


def test_a_tree_of_saved_summaries(spark, monkeypatch, tmp_path):
    """Summaries of days, written and read again, combine in a tree within the reported error."""
    monkeypatch.setattr(Q, "FAN_IN", 2)
    days = [spark.range(1000).select((F.rand(d) * 1000 * (d + 1)).alias("v"), F.lit("k").alias("k")).cache() for d in range(5)]
    for d, rows in enumerate(days):
        Q.merge(Q.summarise(rows, ["k"], F.col("v")), ["k"]).write.parquet(str(tmp_path / f"{d}"))
    saved = spark.read.parquet(*[str(tmp_path / f"{d}") for d in range(5)])
    got = Q.percentiles(Q.merge(saved, ["k"]), ["k"], {"p50": 0.5, "p9": 0.9}).collect()[0]
    every = sorted(r.v for rows in days for r in rows.collect())
    assert got.n == 5000
    for name, p in (("p50", 0.5), ("p9", 0.9)):
        assert abs(every.index(got[name]) + 1 - round(p * 5000)) <= got.rank_error <= 5
