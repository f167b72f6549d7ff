import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gleanframe.operators import references as R


def _orphans(spark, parents, refs):
    p = spark.createDataFrame(parents, "k string, a int, b int")
    r = spark.createDataFrame(refs, "k string, m int")
    spans = R.parent_spans(p, "x", F.col("k"), F.col("a"), F.col("b"))
    got = R.orphans(spans, R.reference_months(r, "x", F.col("k"), F.col("m"))).collect()
    return sorted((x.key, x.month, x.n) for x in got)


def test_spans_gaps_and_nulls(spark):
    parents = [("a", 10, None), ("b", 10, 12), ("b", 15, 15), ("b", 11, 11), (None, 1, None), ("c", None, None), ("d", 5, 4)]
    refs = [("a", 9), ("a", 10), ("a", 99), *[("b", m) for m in range(9, 17)], ("z", 3), ("z", 3), (None, 3), ("c", 3), ("d", 5), ("a", None)]
    want = [("a", 9, 1), ("b", 9, 1), ("b", 13, 1), ("b", 14, 1), ("b", 16, 1), ("c", 3, 1), ("d", 5, 1), ("z", 3, 2)]
    assert _orphans(spark, parents, refs) == want


def test_empty_sides_and_hot_key(spark):
    assert _orphans(spark, [], []) == [] and _orphans(spark, [("a", 1, None)], []) == []
    assert _orphans(spark, [], [("hot", 5)] * 3000) == [("hot", 5, 3000)]
    assert _orphans(spark, [("hot", 5, None)] * 3000, [("hot", 5)] * 3000) == []


def test_keys_that_share_a_hash():
    rows = pd.DataFrame({"place": [7, 7, 9], "key": ["a", "b", "c"], "month": [1, 5, 1], "until": [3, R.OPEN, R.OPEN]})
    ranges = R._Range([rows])
    place, key, month = np.array([7, 7, 7, 7, 9, 8]), np.array(["a", "b", "x", "b", "c", "c"], object), np.array([2, 2, 2, 6, 1, 1])
    assert ranges.stands(place, key, month).tolist() == [True, False, False, True, True, False]


def test_random_against_brute_force(spark):
    rng = np.random.default_rng(5)
    parents = [(f"k{rng.integers(40)}", int(a), None if rng.random() < 0.3 else int(a + rng.integers(-1, 6))) for a in rng.integers(0, 30, 150)]
    refs = [(f"k{rng.integers(60)}", int(m)) for m in rng.integers(0, 40, 400)]
    bad = [(k, m) for k, m in set(refs) if not any(k == p and a <= m and (b is None or m <= b) for p, a, b in parents)]
    assert [(k, m) for k, m, _ in _orphans(spark, parents, refs)] == sorted(bad)
