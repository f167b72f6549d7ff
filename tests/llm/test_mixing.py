from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import mixing as M
from gleanframe.llm.mixing_queries import p8_mix, p8_shares


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_permutation_is_one_to_one(n):
    p = M.permute(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(p.tolist()) == list(range(n))
    if n > 100:
        assert (p != M.permute(np.arange(n), np.full(n, n), np.full(n, 98))).mean() > 0.9


def test_blocks_hold_every_token_once(spark):
    docs = [("a", i, int(t)) for i, t in enumerate(np.random.default_rng(1).integers(0, 90, 200))] + [("b", 900, 1000), ("b", 901, None)]
    df = spark.createDataFrame(docs, "source string, doc_id bigint, tokens bigint")
    got = M.block_spans(df, 32).collect()
    seen = Counter((r.doc_id, t) for r in got for t in range(r.from_token, r.to_token))
    assert set(seen.values()) == {1} and len(seen) == sum(t or 0 for _, _, t in docs)
    places = Counter((r.source, r.block, r["at"] + i) for r in got for i in range(r.to_token - r.from_token))
    assert set(places.values()) == {1} and max(p for _, _, p in places) == 31
    for s in "ab":
        total = sum(t or 0 for x, _, t in docs if x == s)
        assert sum(k[0] == s for k in places) == total and max(k[1] for k in places if k[0] == s) == -(-total // 32) - 1


def test_mix_keeps_caps_and_reaches_shares(spark):
    docs = spark.createDataFrame([(" A " if i % 2 else "a", i, 64) for i in range(4000)] + [("B", 10_000 + i, 64) for i in range(500)] + [("x", 1, 9), (None, 2, 9)], "source string, doc_id bigint, tokens bigint")
    docs = M.written(spark, docs, "t")
    targets = spark.createDataFrame([("A", 0.6, 1), ("b", 0.3, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets, block=64).cache()
    uses = {r.source: r.m for r in mixed.groupBy("source", "doc_id", "from_token").count().groupBy("source").agg(F.max("count").alias("m")).collect()}
    assert uses["a"] == 1 and uses["b"] in (2, 3) and set(uses) == {"a", "b"}
    share = {r.source: r for r in M.reached(mixed, docs, targets).collect()}
    assert abs(share["a"].reached_share - 2 / 3) < 0.03 and share["gone"].reached_share == 0 and share["gone"].documents == 0
    assert mixed.groupBy("shard", "slot").count().where("count > 1").count() == 0
    again = M.mix(docs, targets, block=64)
    assert again.exceptAll(mixed).count() == 0
    total = mixed.select("shard", "slot").distinct().count()
    assert total >= 0.8 * min(4000 * 1.5, 1500 * 3)


def test_numbers_in_ranges_and_a_draw_beyond_the_cap(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 2)
    monkeypatch.setattr(M, "SIGMAS", 0.0)  # about every second draw is beyond the cap and drawn anew
    rows = M.slots(spark, {"a": 3000, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}).collect()
    for s, n, cap in (("a", 3000, 1), ("b", 1000, 2)):
        used = Counter((r.epoch, r.block) for r in rows if r.source == s)
        assert set(used.values()) == {1} and max(e for e, _ in used) < cap and max(b for _, b in used) < n
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == 4000


def test_empty(spark):
    docs = M.written(spark, spark.createDataFrame([], "source string, doc_id bigint, tokens bigint"), "t")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert M.mix(docs, targets).count() == 0


def test_p8_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    shares = p8_shares(spark, d).collect()
    have = [r for r in shares if r.documents]
    whole = sum(r.target_share for r in have)
    assert all(abs(r.reached_share - r.target_share / whole) < 0.05 and r.most_repeats <= r.max_repeats for r in have)
    assert set(p8_mix(spark, d).columns) == {"shard", "slot", "at", "source", "epoch", "block", "doc_id", "from_token", "to_token"}
