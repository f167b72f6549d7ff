import zipfile

import pytest
from brute import instant, key
from pyspark.sql import functions as F

from gleanframe.functions import external as E
from gleanframe.operators import lookup, sequence, state
from gleanframe.plans import library
from gleanframe.sources import logs, reports, table, workbook
from gleanframe.streaming import flows


def _book(path, rows):
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    body = "".join(f"<row r='{i}'>" + "".join(cell(c, i, v) for c, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_rates_by_suffix_and_override(spark, tmp_path):
    _book(tmp_path / "r.xlsx", [["Note", "Model name", "INPUT price", "Output price"], ["x", "m", 2.5, "n/a"], [None, "k", 1, 3], ["late", "m", 4, None], ["", " ", 9, 9]])
    got = workbook.rate_table(spark, str(tmp_path / "r.xlsx"))
    assert {tuple(r) for r in got.collect()} == {("m", "in", 4.0), ("m", "out", 0.0), ("k", "in", 1.0), ("k", "out", 3.0)}
    assert {tuple(r) for r in workbook.flat_rates(spark, got, ["in", "out"]).collect()} == {("m", 4.0, 0.0), ("k", 1.0, 3.0)}
    (tmp_path / "bad.xlsx").write_text("no workbook")
    assert workbook.rate_table(spark, str(tmp_path / "bad.xlsx")).count() == 0
    (tmp_path / "o.json").write_text('{"models": {"z": {"in": 1}}}')
    spark.conf.set("spark.gleanframe.rates", str(tmp_path / "o.json"))
    try:
        assert [tuple(r) for r in workbook.rate_table(spark, "ignored.xlsx").collect()] == [("z", "in", 1.0)]
    finally:
        spark.conf.unset("spark.gleanframe.rates")


def test_typed_settings(spark):
    got = workbook.settings(spark, {"hours": 6, "share": 0.5, "on": False, "name": "x", "left": 3, "blank": 1}, environment={"HOURS": "8", "SHARE": "a", "ON": "Yes", "BLANK": " "})
    assert got == {"hours": 8, "share": 0.5, "on": True, "name": "x", "left": 3, "blank": 1}


def test_first_and_newest_files(spark, tmp_path):
    import os

    for i, n in enumerate(("b.jpg", "a.jpg", "c.jpg", "d.jpg")):
        (tmp_path / n).write_bytes(b"1")
        os.utime(tmp_path / n, (1_700_000_000 + i * 100,) * 2)
    files = logs.scan_folder(spark, str(tmp_path))
    assert [r.path[-5:] for r in logs.first_files(files, 2).collect()] == ["a.jpg", "b.jpg"]
    assert [r.path[-5:] for r in logs.first_files(files, 3, newest=True).collect()] == ["d.jpg", "c.jpg", "a.jpg"]


def test_reports_and_audit(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    lines = reports.markdown_lines(df, ["k", "n"], [F.col("k")])
    reports.append_report(lines, str(tmp_path / "r"))
    assert [r.line for r in reports.read_report(spark, str(tmp_path / "r")).collect()] == ["| k | n |", "| --- | --- |", "| a |  |", "| b | 2 |"]
    for _ in range(2):
        reports.replace_latest(lines, str(tmp_path / "l"))
    assert reports.read_report(spark, str(tmp_path / "l")).count() == 4
    audit = spark.createDataFrame([("2025-01-01", "prompt", "x", "two\nlines")], "day string, kind string, name string, text string")
    for _ in range(2):
        reports.append_audit(audit, str(tmp_path / "a"))
    assert [(r.kind, r.text) for r in reports.read_audit(spark, str(tmp_path / "a")).collect()] == [("prompt", "two\nlines")] * 2


def test_a_joint_commit_that_dies_changes_neither_table(spark, tmp_path):
    both = state.VersionedTables(spark, str(tmp_path / "v"), ("a", "b"))
    rows = spark.range(3)
    both.commit({"a": rows, "b": rows})
    broken = rows.select(F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        both.commit({"a": rows.limit(0), "b": broken})
    assert {n: t.count() for n, t in both.read().items()} == {"a": 3, "b": 3}


def test_exact_median_by_counts(spark):
    rows = [("a", v) for v in (5, 1, 9, 9)] + [("b", 7), ("c", None), (None, 2), (None, 3)]
    got = {r.k: (r.n, r.median) for r in lookup.exact_median(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v").collect()}
    assert got == {"a": (4, 7.0), "b": (1, 7.0), None: (2, 2.5)}


def test_places_over_ranges(spark):
    got = sequence.positions(spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")), [F.col("x")], "place", slices=7).collect()
    assert all(r.place == r.x + 1 for r in got) and len(got) == 1000
    assert sequence.positions(spark.range(0), [F.col("id")], "place").count() == 0


def test_positional_lookup_is_the_same_in_slices(spark):
    stored = spark.range(1, 200).select("id", F.col("id").alias("stored"))
    actual = spark.range(1, 200).where("id % 11 > 4 and id not between 60 and 90").select("id", (F.col("id") + F.floor(F.col("id") / 20) * 40).alias("actual"))
    whole, cut = (sorted(map(tuple, sequence.positional(stored, actual, "id", (120, 700), 5, n).collect())) for n in (1_000_000, 7))
    assert whole == cut and {r[1] for r in whole} == {"near", "wide", "gone", "kept"}


def test_curve_is_the_same_in_slices(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 7 > 0, F.col("id") * 5).alias("v"))
    whole, cut = (sorted(map(tuple, sequence.curve(rows, "k", s, [F.col("id")], "v").collect())) for s in (F.lit(0), F.floor(F.col("id") / 10)))
    assert whole == cut and max(r[-1] for r in whole) == 100


def test_posting_hours_against_brute_force(spark, tiny):
    posted, latest = {}, {}
    for r in table(spark, tiny, "images").collect():
        t = instant(r.posted_at, r.wall_zone)
        if (k := key(r.tweet_id)) and t is not None:
            posted[k] = min(t, posted.get(k, t))
    for r in table(spark, tiny, "tweet_metrics").collect():
        if k := key(r.tweet_id):
            latest[k] = max(latest.get(k, (r.loaded_at, r.metric_id, r.impressions or 0)), (r.loaded_at, r.metric_id, r.impressions or 0))
    by = {}
    for k, t in posted.items():
        if k in latest:
            by.setdefault((t // 3_600_000_000 + 8) % 24, []).append(latest[k][2])
    import statistics

    want = [(h, len(v), float(statistics.median(v))) for h, v in sorted(by.items())]
    assert [tuple(r) for r in library.median_by_posting_hour(spark, tiny).collect()] == want and want


def test_ingest_keeps_late_rows_and_enters_no_key_twice(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, ts timestamp, v int"
    for rows in ([("a", "2025-06-01", 1), ("b", "2025-06-02", 2)], [("c", "2020-01-01", 3), ("a", "2019-01-01", 4), (None, "2025-01-01", 5)], [("c", "2025-09-01", 6)]):
        spark.createDataFrame(rows, "k string, t string, v int").select("k", F.col("t").cast("timestamp").alias("ts"), "v").write.mode("append").parquet(src)
        flows.ingest_distinct(flows.file_stream(spark, src, spark.createDataFrame([], schema).schema), ["k"], [F.col("ts")], out)
    assert sorted((r.k, r.v) for r in flows.read_batches(spark, out).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_publish_recovers_and_keeps_the_day_cap(spark, tmp_path):
    done = state.VersionedTable(spark, str(tmp_path / "done"))
    queue = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert flows.refresh_due(done, 6)

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        flows.publish(queue, done, "id", [F.col("id")], dies)
    assert [tuple(r)[:2] for r in done.read().collect()] == [(0, "sending")]
    sent = []
    for _ in range(4):
        flows.publish(queue, done, "id", [F.col("id")], lambda df: sent.extend(r.id for r in df.collect()) or df, most_a_day=3)
    assert sent == [0, 1, 2] and {r.state for r in done.read().collect()} == {"sent"}
    assert not flows.refresh_due(done, 6) and flows.refresh_due(done, 0)


def test_decisions_fail_closed_or_open(spark):
    df = spark.createDataFrame([("good", [b"1", b"2"]), ("none", [b"3"]), (None, None), ("dies", [b"4"])], "t string, pictures array<binary>")

    def factory():
        def call(batch):
            if any(b"4" in list(x) for x in batch):
                raise ValueError("never again")
            return [{"yes": True, "best": len(x)} if len(x) > 1 else None for x in batch]

        return call

    got = df.repartition(1).orderBy("t").select("t", E.decided(factory, F.col("pictures"), "yes boolean, best int", {"yes": False}).alias("a"))
    assert {r.t: (r.a.yes, r.a.best, r.a.ok) for r in got.collect()} == {"good": (False, None, False), "none": (False, None, False), None: (False, None, False), "dies": (False, None, False)}
    got = df.where("t <> 'dies'").select("t", E.decided(factory, F.col("pictures"), "yes boolean, best int", {"yes": True}).alias("a"))
    assert {r.t: (r.a.yes, r.a.best, r.a.ok) for r in got.collect()} == {"good": (True, 2, True), "none": (True, None, False)}


def test_the_gate_spares_the_client(spark, tmp_path):
    def factory():
        def call(batch):
            assert "cheap" not in batch
            return [{"yes": True} for _ in batch]

        return call

    df = spark.createDataFrame([("cheap",), ("dear",), (None,)], "t string")
    got = E.gate_then_ask(df, F.when(F.col("t") == "cheap", F.lit(False)), F.col("t"), "yes", factory, "yes boolean", {"yes": False})
    assert {r.t: r.yes for r in got.collect()} == {"cheap": False, "dear": True, None: False}


def test_capabilities(spark):
    c = E.Capabilities(up=F.upper, twice=lambda x: F.concat(x, x))
    assert c.unknown(["up", "polish"]) == ["polish"]
    assert spark.range(1).select(c.applied(["up", "polish", "twice"], F.lit("a"))).first()[0] == "AA"


def test_no_candidates(spark):
    df = spark.createDataFrame([(["", " "],), (None,), (["a"],), (["a", "b"],)], "c array<string>")
    assert [r[0] for r in df.select(E.picked(F.col("c"), F.lit(1))).collect()] == [None, None, "a", "b"]
