import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.llm import packing as P
from gleanframe.llm.packing_queries import p7_assign, p7_fill


def _check(rows, sizes, capacity):
    """Whole items in one container, split ones in order, nothing lost, nothing overfull."""
    pieces, bins = {}, {}
    for item, piece, start, size, bin_ in rows:
        pieces.setdefault(item, []).append((piece, start, size))
        bins[bin_] = bins.get(bin_, 0) + size
    assert set(pieces) == set(sizes)
    for item, got in pieces.items():
        got.sort()
        assert sum(s for _, _, s in got) == sizes[item]
        assert len(got) == max(1, -(-sizes[item] // capacity))
        assert [(p, s) for p, s, _ in got] == [(i, i * capacity) for i in range(len(got))]
    assert max(bins.values()) <= capacity
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200), st.sampled_from([100, 128, 5000]))
def test_plan_covers_the_histogram(sizes, capacity):
    classes, counts = np.unique(sizes, return_counts=True)
    plan = P.configuration_plan(classes, counts, capacity)
    assert all(plan.filled[c] >= n for c, n in zip(classes.tolist(), counts.tolist(), strict=True))
    assert sum(sizes) / capacity <= plan.bound <= plan.containers <= 2 * sum(classes * counts) / capacity + 1


@pytest.mark.parametrize("capacity", [256, 2048])
def test_program_meets_its_bound_where_first_fit_does_not(capacity):
    rng = np.random.default_rng(0)
    sizes = np.minimum(capacity, np.append(rng.integers(capacity // 5, capacity * 3 // 4, 6000), rng.integers(capacity // 16, capacity // 4, 4000)))
    classes, counts = np.unique(sizes, return_counts=True)
    fit, plan = P.configuration_plan(classes, counts, capacity, ()), P.configuration_plan(classes, counts, capacity)
    assert plan.rounds > 0 and plan.containers <= fit.containers and plan.containers - plan.bound <= 0.002 * plan.bound + 1
    assert fit.containers > fit.bound


def test_duals_prove_more_than_the_volume():
    # three items of 34 never share a container of 100, so 300 of them need 150 containers
    plan = P.configuration_plan(np.array([34]), np.array([300]), 100)
    assert plan.containers == 150
    assert P.lower_bound(np.array([34]), np.array([300]), np.array([34.0]), 100) == 150


def test_empty_histogram():
    assert P.configuration_plan(np.array([], np.int64), np.array([], np.int64), 10).containers == 0


def test_pricing_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        u, v, most = rng.integers(1, 9, 4), rng.random(4), rng.integers(1, 4, 4)
        got = P.price_pattern(u, v, most, 15)
        best = max(sum(a * v[i] for i, a in enumerate(c)) for c in np.ndindex(*(most + 1)) if sum(a * u[i] for i, a in enumerate(c)) <= 15)
        assert (got <= most).all() and got @ u <= 15 and got @ v == pytest.approx(best)


def test_rows_with_splits_zeros_nulls_and_a_hot_size(spark):
    sizes = {i: 30 for i in range(400)} | {500: 0, 501: 0, 502: 100, 503: 257, 504: 1, 505: 99}
    items = spark.createDataFrame([(i, s, "x") for i, s in sizes.items()] + [(900, None, "x")], "item bigint, size bigint, container string")
    kinds = spark.createDataFrame([("c", 100), ("d", 64), ("none", None)], "container string, capacity_tokens int")
    placed, plans = P.pack(items, kinds)
    for kind, capacity in (("c", 100), ("d", 64)):
        rows = [(r.item, r.piece, r.start, r.size, r.bin) for r in placed.where(F.col("container") == kind).collect()]
        used = _check(rows, sizes, capacity)
        assert used <= plans[kind].containers
    assert P.pack(items.limit(0), kinds)[0].count() == 0


def test_hot_size_is_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)
    sizes = {i: 30 for i in range(1000)} | {2000 + i: 10 for i in range(70)}
    placed, _ = P.pack(spark.createDataFrame(list(sizes.items()), "item bigint, size bigint"), spark.createDataFrame([("c", 100)], "container string, capacity_tokens int"))
    assert _check([(r.item, r.piece, r.start, r.size, r.bin) for r in placed.collect()], sizes, 100) <= 334


def test_p7_is_nearly_full(spark):
    d = "/root/testdata/sf0.01"
    rows = p7_assign(spark, d).collect()
    assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{d}/documents.parquet").count()
    fill = {r.container: r for r in p7_fill(spark, d).collect()}
    assert all(f.fullest <= f.capacity for f in fill.values())
    assert all(f.least_bins <= f.proven_bins <= f.bins for f in fill.values())
    assert fill["small"].fill > 0.99 and fill["medium"].fill > 0.97 and fill["large"].fill > 0.9
