from pyspark.sql import functions as F

from gleanframe.operators.state import VersionedTable
from gleanframe.sources import logs
from gleanframe.streaming import flows


def test_cache_first_response_holds(spark, tmp_path):
    c = logs.ResponseCache(spark, str(tmp_path / "c"))
    req = spark.createDataFrame([("p1",), ("p2",)], "p string")
    assert {r.response for r in c.lookup(req, F.sha2("p", 256)).collect()} == {None}
    put = lambda v: c.put(req.where("p = 'p1'").select(F.sha2("p", 256).alias("key"), F.lit(v).alias("response")))
    put("one")
    put("two")
    assert {(r.p, r.response) for r in c.lookup(req, F.sha2("p", 256)).collect()} == {("p1", "one"), ("p2", None)}


def test_rates_and_bad_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"models": {"m": {"in": 2.0, "out": 8}}}')
    (tmp_path / "b.json").write_text("not json")
    assert {tuple(r) for r in logs.rates(spark, str(tmp_path / "a.json")).collect()} == {("m", "in", 2.0), ("m", "out", 8.0)}
    assert logs.rates(spark, str(tmp_path / "b.json")).count() == 0


def test_folder_scan(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("a.jpg", "b.txt", "x/c.png"):
        (tmp_path / n).write_bytes(b"123")
    got = logs.scan_folder(spark, str(tmp_path)).select("path", "length").collect()
    assert sorted(r.path[-5:] for r in got) == ["a.jpg", "c.png"] and {r.length for r in got} == {3}


def test_breaker_state_survives_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, ok boolean"
    for n in (1, 2):
        spark.createDataFrame([("a", False), ("b", False), ("b", True)], schema).write.mode("append").parquet(src)
        stream = flows.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        flows.attempt_breaker(stream, "k", ~F.col("ok"), 2, out)
    assert {(r.key, r.attempts) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 2)}


def test_publish_sends_each_row_once(spark, tmp_path):
    done, sent = VersionedTable(spark, str(tmp_path / "done")), []
    queue = spark.createDataFrame([(2,), (1,), (3,)], "id int")

    def send(df):
        sent.extend(r.id for r in df.collect())
        return df

    for _ in range(4):
        flows.publish(queue, done, "id", [F.col("id")], send)
    assert sent == [1, 2, 3] and {r.state for r in done.read().collect()} == {"sent"}
