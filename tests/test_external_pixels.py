import numpy as np
from pyspark.sql import functions as F

from gleanframe.functions import external, pixels
from gleanframe.sources.logs import ResponseCache


class _Gone(Exception):
    status_code = 404


def test_tries_again_only_after_passing_errors():
    calls, waits = [], []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return batch

    assert external.tried(flaky, [1], 4, 1.0, 3.0, 2.0, waits.append) == [1] and waits == [1.0, 2.0]
    assert not external.passing(_Gone()) and external.passing(ConnectionError()) and not external.passing(ValueError())


def test_failures_open_or_closed(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string").coalesce(1)
    good = df.select("t", external.asked(lambda: lambda b: [x.upper() for x in b], F.col("t"), "no").alias("x")).collect()
    assert {(r.t, r.x) for r in good} == {("a", "A"), ("b", "B"), (None, "no")}
    bad = df.select(external.asked(lambda: lambda b: [][1], F.col("t"), "no", attempts=1).alias("x")).collect()
    assert {r.x for r in bad} == {"no"}


def test_cache_is_asked_first_and_never_stores_failures(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")

    def ask(factory):
        got = external.asked_through_cache(df, cache, F.sha2("t", 256), factory, F.col("t"), "x", None)
        return sorted((r.t, r.x) for r in got.collect())

    def broken():
        def call(batch):
            raise ValueError

        return call

    assert ask(broken) == [("a", None), ("a", None), ("b", None)]
    assert ask(lambda: lambda b: [f"{x}1" for x in b]) == [("a", "a1"), ("a", "a1"), ("b", "b1")]
    assert ask(lambda: lambda b: [f"{x}2" for x in b]) == [("a", "a1"), ("a", "a1"), ("b", "b1")]


def test_fingerprints_are_stable_under_small_changes(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:90, 0:120]
    px = np.stack([128 + 80 * np.sin(x / 17 + y / 9), 100 + 50 * np.cos(y / 13), x * 2.0], 2).clip(0, 255)
    other = rng.integers(0, 255, (50, 70, 3)).astype(float)
    near = (pixels.fingerprint(px) ^ pixels.fingerprint((px + rng.normal(0, 4, px.shape)).clip(0, 255))) & (2**64 - 1)
    far = (pixels.fingerprint(px) ^ pixels.fingerprint(other)) & (2**64 - 1)
    assert near.bit_count() <= 6 < far.bit_count()
    rows = [(px.astype(np.uint8).tobytes(), 90, 120), (None, 1, 1)]
    df = spark.createDataFrame(rows, "raw binary, h int, w int")
    got = df.select(pixels.picture_fingerprint("raw", "h", "w").alias("f"), pixels.picture_measures("raw", "h", "w").alias("m"), pixels.fit_scale(F.col("h"), F.col("w"), 60, 60).alias("s")).collect()
    assert got[0].f == pixels.fingerprint(px.astype(np.uint8).astype(float)) and got[1].f is None
    assert abs(got[0].m.blue - 119) < 1 and got[0].s == 0.5


def test_corrections_leave_good_pictures_alone():
    flat = np.full((4, 4, 3), 90.0)
    assert (pixels.levelled(flat) == flat).all() and np.allclose(pixels.balanced(flat), flat)
    warm = np.full((4, 4, 3), [120.0, 90.0, 60.0])
    assert np.allclose(pixels.balanced(warm), 90)
