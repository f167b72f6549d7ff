import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.functions.scalars import picture_code
from gleanframe.operators import lookup
from gleanframe.plans import catalog
from gleanframe.sources import table


def _near(a, b, most):
    return a is not None and b is not None and (a ^ b).bit_count() <= most


def test_spelling_of_fingerprints(spark):
    texts = ["0xFF00FF00FF00FF00", " phash: ff00ff00ff00ff00\t", "FF00FF00FF00FF00", "hash=ff00ff00ff00ff00", "0xff", "0x0xff00ff00ff00ff00", None]
    got = spark.createDataFrame([(x,) for x in texts], "p string").select(picture_code(F.col("p"))).collect()
    assert [r[0] for r in got] == [0xFF00FF00FF00FF00 - (1 << 64)] * 4 + [None] * 3


@pytest.mark.parametrize("near", [2, 6, 12])
def test_earliest_equals_exhaustive(near, monkeypatch):
    monkeypatch.setattr(lookup, "_PAIRS_AT_ONCE", 50)
    rng = random.Random(near)
    nodes = [rng.getrandbits(64) for _ in range(300)]
    asked = [n ^ sum(1 << b for b in rng.sample(range(64), k % (near + 3))) for k, n in enumerate(nodes)] + [rng.getrandbits(64) for _ in range(50)]
    at = [rng.randrange(40) for _ in nodes]
    want = {i: min(t) for i, a in enumerate(asked) if (t := [t for n, t in zip(nodes, at, strict=True) if _near(a, n, near)])}
    q, first = lookup._earliest(np.array(asked, np.uint64), np.array(nodes, np.uint64), np.array(at), near)
    assert dict(zip(q.tolist(), first.tolist(), strict=True)) == want and len(q) == len(want)


def test_shards_and_parts_do_not_change_the_rows(spark, monkeypatch):
    rng = random.Random(3)
    scenes = [rng.getrandbits(63) for _ in range(40)]
    rows = [(i, rng.choice(scenes) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(9))), rng.choice("ar"), rng.randrange(9)) for i in range(400)]
    want = [i for i, c, _, b in rows if any(_near(c, k, 12) for _, k, s, t in rows if s == "a" and t < b)]
    df = spark.createDataFrame(rows, "i int, c bigint, s string, b int")
    for cap in (1 << 20, 100):
        monkeypatch.setattr(lookup, "SHARD_CODES", cap)
        monkeypatch.setattr(lookup, "PART_CODES", cap)
        assert sorted(r.i for r in lookup.near_earlier(df, F.col("s") == "a", "c", "b", 12).collect()) == want


def test_every_batch_is_probed_at_the_reference_distance(spark, tiny):
    rows = table(spark, tiny, "images").select("id", "batch_no", "status", picture_code(F.col("phash")).alias("c")).collect()
    code = {r.id: None if r.c is None else r.c % (1 << 64) for r in rows}
    kept = [r for r in rows if r.status != "rejected"]
    want = sorted(r.id for r in rows if any(k.batch_no < r.batch_no and _near(code[r.id], code[k.id], 12) for k in kept))
    assert sorted(r.id for r in catalog.near_dup_history(spark, tiny).collect()) == want
    assert min(r.batch_no for r in rows if r.id in want) < 24
