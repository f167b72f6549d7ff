from datetime import date, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.operators.rolling import Measure, trailing, two_stack

D0 = date(2025, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=80), st.integers(1, 12))
def test_two_stack_equals_recomputing(values, w):
    v = np.array(values, np.int64)
    low = np.iinfo(np.int64).min
    assert two_stack(v, w, np.add, 0).tolist() == [sum(values[max(0, i - w + 1) : i + 1]) for i in range(len(values))]
    assert two_stack(v, w, np.maximum, low).tolist() == [max(values[max(0, i - w + 1) : i + 1]) for i in range(len(values))]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = {}
    for e in ("a", "b", None, "c d"):
        for d in sorted(set(rng.integers(0, 90, 25).tolist())):
            rows[e, d] = None if rng.random() < 0.2 else int(rng.integers(0, 100))
    rows["hot", 0] = 1
    df = spark.createDataFrame([(e, D0 + timedelta(d), v, 7) for (e, d), v in rows.items()], "e string, d date, v bigint, extra int")
    got = {(r.e, (r.d - D0).days): r for r in trailing(df, "e", "d", (7, 30), (Measure("s", "v"), Measure("m", "v", "max"), Measure("n", "v", "count"))).collect()}
    days = {e: [d for x, d in rows if x == e] for e, _ in rows}
    assert set(got) == {(e, d) for e, ds in days.items() for d in range(min(ds), max(ds) + 1)}
    for (e, d), r in got.items():
        for w in (7, 30):
            win = [rows[e, x] for x in range(d - w + 1, d + 1) if rows.get((e, x)) is not None]
            assert (r[f"s_{w}"], r[f"m_{w}"], r[f"n_{w}"]) == (sum(win), max(win) if win else None, len(win))
            assert r[f"days_{w}"] == min(w, d - min(days[e]) + 1)


def test_empty_and_null_days(spark):
    df = spark.createDataFrame([("a", None, 1)], "e string, d date, v bigint")
    assert trailing(df, "e", "d", (7,), (Measure("s", "v"),)).count() == 0


def test_a_stray_early_day_is_filled_entity_by_entity(spark, monkeypatch):
    from gleanframe.operators import rolling

    monkeypatch.setattr(rolling, "DAYS_AT_ONCE", 10)
    rows = [(e, d, 1) for e in "abc" for d in ("0900-01-01", "0900-02-15", "0900-02-16")]
    df = spark.createDataFrame(rows, "e string, d string, v bigint").select("e", F.col("d").cast("date").alias("d"), "v")
    got = rolling.trailing(df, "e", "d", (7,), (rolling.Measure("v", "v"),)).collect()
    assert len(got) == 3 * 47 and sum(r.v_7 for r in got) == 3 * (7 + 2 + 1)
