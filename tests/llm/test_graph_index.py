import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import graph_index as G
from gleanframe.llm.dedup_queries import p2_found, p2_links
from gleanframe.sources import table


def _altered(rng, base, bits):
    return np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else b for b, k in zip(base, bits, strict=True)], np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_search_against_exhaustive_search(n):
    rng = np.random.default_rng(n)
    nodes = rng.integers(0, 2**64, n, dtype=np.uint64)
    queries = rng.integers(0, 2**64, 50, dtype=np.uint64)
    if n:
        queries = np.append(queries, _altered(rng, rng.choice(nodes, 500), rng.integers(0, 9, 500)))
    shard = G.Shard.built(nodes)
    q, c = shard.search(queries)
    eq, ec = G.exhaustive(queries, nodes)
    got, want = set(zip(q.tolist(), c.tolist(), strict=True)), set(zip(eq.tolist(), ec.tolist(), strict=True))
    assert len(q) == len(got) and got <= want and len(got) >= 0.998 * len(want)


def test_width_is_tuned_to_the_recall_and_narrow_beams_lose_pairs():
    rng = np.random.default_rng(1)
    nodes = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    shard = G.Shard.built(nodes)
    queries = _altered(rng, rng.choice(nodes, 2000), np.full(2000, 6))
    truth = len(G.exhaustive(queries, nodes)[0])
    recall = [len(shard.search(queries, w)[0]) / truth for w in (2, 8, shard.width)]
    assert recall == sorted(recall) and recall[0] < 0.95 and recall[2] > 0.99
    assert shard.recall >= G.RECALL and shard.width in G.WIDTHS[1:]


def test_links_alone_lead_to_the_near_nodes():
    """From random entries the walk over the links finds what greedy routing can, far more than the entries hold."""
    rng = np.random.default_rng(2)
    nodes = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    shard = G.Shard.built(nodes, tune=False)
    shard.entries = lambda q, w: np.tile(np.arange(0, 4000, 125), (len(q), 1))
    src = rng.choice(4000, 300)
    q, _ = shard.search(_altered(rng, shard.codes[src], np.full(300, 3)), 64)
    assert len(q) >= 0.9 * 300 > 300 * 32 / 4000


def test_a_beam_full_of_hits_is_widened():
    rng = np.random.default_rng(3)
    scene = np.unique(_altered(rng, np.zeros(3000, np.uint64), rng.integers(0, 4, 3000)))
    nodes = np.unique(np.append(scene, rng.integers(0, 2**64, 5000, dtype=np.uint64)))
    shard = G.Shard.built(nodes)
    q, _ = shard.search(np.array([0], np.uint64), 4)
    assert len(q) == len(G.exhaustive(np.array([0], np.uint64), nodes)[0]) > 1000


def test_row_round_trip():
    nodes = np.random.default_rng(4).integers(0, 2**64, 500, dtype=np.uint64)
    a = G.Shard.built(nodes)
    b = G.Shard.of_row(a.row())
    assert (a.codes == b.codes).all() and (a.links == b.links).all() and (a.orders == b.orders).all() and (a.width, a.recall) == (b.width, b.recall)


def test_schemes_keep_the_visits_few():
    assert [G.scheme_of(n) for n in (0, 1, 400_000, 10**6, 10**8, 10**10, 10**12)] == [0, 0, 0, 1, 1, 2, 3]


def test_segments_cover_every_earlier_batch_once(spark):
    n = 23
    df = spark.range(n).select(F.col("id").cast("int").alias("r"))
    nodes = {r.r: {(s.level, s.first) for s in r.s} for r in df.select("r", G.node_segments(F.col("r"), n).alias("s")).collect()}
    for r in df.select("r", G.query_segments(F.col("r"), n).alias("s")).collect():
        covered = sorted(x for s in r.s for x in range(s.first, s.first + 2**s.level))
        assert covered == list(range(r.r))
        for s in r.s:
            assert all((s.level, s.first) in nodes[x] for x in range(s.first, s.first + 2**s.level))
    assert set(G.segment_sizes([1] * n)) == {s for x in nodes.values() for s in x}


def _brute(rows):
    sha = lambda s: m[1] if (m := re.fullmatch(r"\s*(?:sha256:)?([0-9a-f]{64})\s*", (s or "").lower())) else None
    code = lambda s: int(m[1], 16) if (m := re.fullmatch(r"\s*(?:0x)?([0-9a-f]{16})\s*", (s or "").lower())) else None
    rows = [(r.id, r.batch_no, r.status != "rejected", sha(r.sha256), code(r.phash)) for r in rows if r.batch_no is not None]
    out = set()
    for a in rows:
        for b in rows:
            if a[1] < b[1] and a[2] and ((a[3] and a[3] == b[3]) or (a[4] is not None and b[4] is not None and (a[4] ^ b[4]).bit_count() <= 6)):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_p2_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = p2_found(spark, d).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == _brute(table(spark, d, "images").collect())


@pytest.mark.parametrize(("nodes", "schemes"), [(7, G.SCHEMES), (7, ((1, 0),))])
def test_cut_shards_give_the_same_pairs(spark, monkeypatch, nodes, schemes):
    d = "/root/testdata/sf0.001"
    want = _brute(table(spark, d, "images").collect())
    monkeypatch.setattr(G, "SHARD_NODES", nodes)
    monkeypatch.setattr(G, "SHARD_QUERIES", 20)
    monkeypatch.setattr(G, "SCHEMES", schemes)
    assert {tuple(r) for r in p2_found(spark, d).collect()} == want and want


def test_stored_graphs_are_not_shuffled(spark):
    """The search reads the stored graphs bucket by bucket, without an exchange of them."""
    plan = p2_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    search = next(i for i, x in enumerate(plan) if "FlatMapCoGroupsInPandas [shard#" in x and "part#" not in x)
    scan = next(i for i in range(search, len(plan)) if "FileScan parquet" in plan[i])
    assert "links" in plan[scan] and "Bucketed: true" in plan[scan]
    assert not any("Exchange" in x for x in plan[search:scan])


def test_three_of_nine_bands(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(G, "SCHEMES", ((9, 3),))
    schema = "level int, first int, code bigint"
    nodes, queries = [(0, 0, 5), (0, 0, -1)], [(0, 0, 2), (0, 0, -1 << 6), (0, 0, -1 << 7)]
    G.build_index(spark.createDataFrame(nodes, schema), {(0, 0): 2}, str(tmp_path / "i"))
    got = G.search_index(spark, str(tmp_path / "i"), spark.createDataFrame(queries, schema).withColumn("rank", F.lit(1)))
    assert sorted((r.code, r.node_code) for r in got.collect()) == [(-1 << 6, -1), (2, 5)]


def _history_rows(spark, d):
    return table(spark, d, "images").select(
        "id", "batch_no", G.file_hash(F.col("sha256")).alias("sha"), G.picture_code(F.col("phash")).alias("code"), (F.col("status") != "rejected").alias("accepted")
    )


def test_history_by_batches_equals_all_at_once(spark, tmp_path):
    rows = _history_rows(spark, "/root/testdata/sf0.01").where("batch_no is not null").cache()
    history, got = G.GraphHistory(spark, str(tmp_path / "h")), set()
    batches = sorted(r[0] for r in rows.select("batch_no").distinct().collect())[-7:]
    rows = rows.where(F.col("batch_no").isin(batches))
    for i, b in enumerate(batches):
        before = history.segments()
        links = history.accept(rows.where(F.col("batch_no") == b))
        if before:
            pairs = history.members(links).join(rows.where(F.col("batch_no") < b).select(F.col("id").alias("old_id")), "old_id", "left_semi")
            got |= {(min(r), max(r)) for r in map(tuple, pairs.collect())}
        if i in (3, 6):  # the schedule
            assert history.compact() > 0
    assert got == {tuple(r) for r in G.duplicate_pairs(rows, "id", "batch_no").collect()} and got
    assert history.segments() == [(2, 0), (1, 4), (0, 6)]


def test_accept_reads_no_records_of_the_history(spark, tmp_path):
    schema = "id bigint, sha string, code bigint, accepted boolean"
    history = G.GraphHistory(spark, str(tmp_path / "h"))
    assert history.accept(spark.createDataFrame([(1, "f", 5, True), (2, None, None, True), (3, "g", 1 << 40, False)], schema)).count() == 0
    shutil.rmtree(tmp_path / "h" / "0-0" / "records")
    got = history.accept(spark.createDataFrame([(4, "f", 4, None), (5, "g", -1 << 20, True), (6, None, None, True)], schema)).collect()
    assert sorted((r.id, r.old_sha or "", r.old_code or 0) for r in got) == [(4, "", 5), (4, "f", 0)]


def test_hot_group_nulls_and_empty(spark):
    schema = "id bigint, b int, sha string, code bigint, accepted boolean"
    rows = [(i, i % 3, None, 42, i % 5 > 0) for i in range(60)] + [(100, None, "x", 42, True), (101, 1, None, None, None), (102, 2, "f", None, None), (103, 0, "f", 1 << 40, None)]
    df = spark.createDataFrame(rows, schema)
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if None not in (a[1], b[1]) and a[1] < b[1] and a[4] in (True, None)
            and ((a[3] is not None and b[3] is not None and (a[3] ^ b[3]).bit_count() <= 6) or (a[2] and a[2] == b[2]))}
    got = [tuple(r) for r in G.duplicate_pairs(df, "id", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.id: (r.file_links, r.picture_links) for r in G.duplicate_links(df, "id", "b").collect()}
    assert len(links) == 63 and links[2] == (0, 33) and links[1] == (0, 17) and links[102] == (1, 0) and links[0] == (0, 0)
    assert G.duplicate_pairs(df.limit(0), "id", "b").count() == 0
    assert G.duplicate_links(df.limit(0), "id", "b").count() == 0


def test_links_count_the_pairs(spark):
    d = "/root/testdata/sf0.001"
    rows = p2_links(spark, d).collect()
    assert len(rows) == table(spark, d, "images").where("batch_no is not null").count()
    assert sum(r.file_links + r.picture_links > 0 for r in rows) > 0


def test_spelling(spark):
    df = spark.createDataFrame([("\t0XFF00FF00FF00FF00\n", " SHA256:" + "Ab" * 32), ("ff00ff00-ff00ff0", "ab" * 31), ("gg00ff00ff00ff00", ""), (None, None)], "p string, s string")
    got = df.select(G.picture_code(F.col("p")), G.file_hash(F.col("s"))).collect()
    assert tuple(got[0]) == (0xFF00FF00FF00FF00 - 2**64, "ab" * 32) and all(tuple(r) == (None, None) for r in got[1:])


def test_both_readings_of_a_fingerprint_agree(spark):
    from gleanframe.functions.scalars import picture_code

    texts = ["0xFF00FF00FF00FF00", " phash: ff00ff00ff00ff00\t", "FF00FF00FF00FF00", "hash=ff00ff00ff00ff00", "0xff", "0x0xff00ff00ff00ff00", None]
    got = spark.createDataFrame([(x,) for x in texts], "p string").select(picture_code(F.col("p")), G.picture_code(F.col("p"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
