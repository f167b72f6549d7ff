import pytest
from brute import instant
from pyspark.sql import functions as F

from gleanframe.functions.timestamps import CANONICAL, with_instant
from gleanframe.plans import dealt
from gleanframe.sources import table

US = 1_000_000
CASES = [
    ("2024-12-14T12:42:38+00:00", None, 1734180158 * US),
    ("  2024-12-14T20:42:38+08:00\u3000", None, 1734180158 * US),
    ("2024-12-14 20:42:38", "Asia/Shanghai", 1734180158 * US),
    ("2024-12-14 20:42:38 Asia/Shanghai", "Europe/Berlin", 1734180158 * US),
    ("2024-12-14T20:42:38+08:00[Europe/Berlin]", None, 1734180158 * US),
    ("1734180158", None, 1734180158 * US),
    ("1734180158123", None, 1734180158123000),
    ("1734180158123456", "Asia/Shanghai", 1734180158123456),
    ("2024-12-14T12:42:38.1234567891Z", None, 1734180158123456),
    ("2024年12月14日 20时42分", "Asia/Shanghai", (1734180158 - 38) * US),
    ("14.12.2024 12:42:38", None, 1734180158 * US),
    ("12/14/2024 12:42:38 PM", " ", 1734180158 * US),
    ("12/14/2024 12:42:38 AM", "", (1734180158 - 43200) * US),
    ("２０２４-１２-１４ １２:４２:３８", "UTC", 1734180158 * US),
    # clocks set forward and back
    ("2026-03-08 02:30:00", "America/New_York", 1772955000 * US),
    ("2025-11-02 01:30:00", "America/New_York", 1762061400 * US),
    # nothing
    ("2025-02-30 11:20:00", None, None),
    ("2025-02-29", None, None),
    ("2024-02-29", None, 1709164800 * US),
    ("0000-00-00 00:00:00", None, None),
    ("2025-13-04T10:00:00Z", None, None),
    ("2025-12-04T24:00:00Z", None, None),
    ("13/14/2024 12:42:38 PM", None, None),
    ("2024-12-14 20:42:38", "Mars/Olympus", None),
    ("2024-12-14 20:42:38 Mars/Olympus", None, None),
    ("25:61", None, None),
    ("", None, None),
    ("\u0001", None, None),
    ("9" * 100_000, None, None),
    (None, "UTC", None),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, t string, z string, want bigint")
    got = with_instant(df, "t", "z", "us").orderBy("i").collect()
    assert [(r.t[:40] if r.t else r.t, r.us) for r in got] == [(c[0][:40] if c[0] else c[0], c[2]) for c in CASES]


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([("1734180158", 1, 2)], "t string, y int, `a.b` int")
    assert with_instant(df, "t", None, "us").columns == ["t", "y", "a.b", "us"]
    assert with_instant(df.limit(0), "t", None, "us").count() == 0


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_p5_against_strptime(spark, scale):
    d = f"/root/testdata/{scale}"
    want = set()
    for name, id_, fields in (("images", "id", ("posted_at", "processed_at")), ("tweet_metrics", "metric_id", ("fetched_at",))):
        rows = table(spark, d, name).select(id_, "wall_zone", *[F.col(f) for f in fields], *[F.col(f).rlike(CANONICAL).alias(f"n_{f}") for f in fields]).collect()
        for r in rows:
            for f in fields:
                if r[f] is not None and not r[f"n_{f}"] and (us := instant(r[f], r["wall_zone"])) is not None:
                    want.add((name, r[id_], f, us))
    got = {tuple(r) for r in dealt.p5_found(spark, d).collect()}
    assert len(got) > 1000
    assert got == want


def test_match_is_not_copied_into_filters(spark, tiny):
    plan = dealt.p5_found(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<y1>") == 1


def test_both_ways_of_reading_the_normal_form_agree(spark):
    stamps = ["2024-02-29T23:59:59+00:00", "2023-02-29T00:00:00+00:00", "0000-01-01T00:00:00+00:00", "0001-01-01T00:00:00+00:00", "9999-12-31T23:59:59.999999+00:00",
              "2024-01-01T24:00:00+00:00", "2024-01-01T00:00:60+00:00", "2024-01-01T00:00:00.1234567899+00:00", "2024-13-01T00:00:00+00:00", "1969-12-31T23:59:59.5+00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "t string")
    a, b = (with_instant(df, "t", None, "us", normal=n).collect() for n in (True, False))
    assert a == b and sum(r.us is not None for r in a) == 5


def test_stamps_stay_in_generated_code(spark, tiny):
    """The stage compiles (a stage beyond the limits of a method would be interpreted), and no filter holds a copy of the match."""
    from gleanframe.plans import dealt

    fallback = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for query in (dealt.p5_found, dealt.p5_quality):
            df = query(spark, tiny)
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not any("Filter" in x and "regexp_replace" in x for x in plan.splitlines())
    finally:
        spark.conf.set("spark.sql.codegen.fallback", fallback)
