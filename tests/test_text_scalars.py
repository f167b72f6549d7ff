from pyspark.sql import functions as F

from gleanframe.functions import scalars as C
from gleanframe.functions import text as T


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).collect()[0].x


def test_weighted_length_and_prefix(spark):
    for t, w in (("hello world", 11), ("", 0), ("📍", 2), ("🍜🌅", 4), ("a📍b", 4), ("中国", 4), ("👍🏽", 2), (None, None)):
        assert one(spark, T.weighted_length(F.col("t")), t=t) == w
    for t, n, want in (("x" * 10 + "📍" * 10, 14, "x" * 10 + "📍" * 2), ("ab📍", 3, "ab"), ("hello", 0, ""), ("hello", -5, ""), ("a" * 279 + "🌅", 280, "a" * 279), ("👍🏽x", 2, "👍🏽"), ("", 5, "")):
        assert one(spark, T.weighted_prefix(F.col("t"), n), t=t) == want


def test_post_text_folds_the_tag(spark):
    def post(caption, line, tag):
        return one(spark, T.post_text(F.col("c"), F.col("l"), tag), c=caption, l=line)

    assert post("x", "📍 Ningbo, CHINA", "China") == "x\n📍 Ningbo, #CHINA"
    assert post("x", "📍 Ningbo, #China", "China") == "x\n📍 Ningbo, #China"
    assert post("x", "📍 Chinatown, Singapore", "China") == "x\n📍 Chinatown, Singapore\n#China"
    assert post("x", None, "China") == "x\n#China"
    assert post("", "📍 Kyoto", "") == "📍 Kyoto"
    long = post("word " * 200, "📍 18:04 Shanghai, China", "China")
    assert long.endswith("Shanghai, #China") and one(spark, T.weighted_length(F.col("t")), t=long) <= 280


def test_small_text_functions(spark):
    assert one(spark, T.first_line(F.col("t")), t=" a \nb") == "a" and one(spark, T.first_line(F.col("t")), t="\nb") is None
    assert one(spark, T.safe_label(F.col("t"), 9), t=" Ab  c!d é f") == "Ab-c_d-_-"
    assert one(spark, T.bar(F.col("t")), t=99) == "█" * 28


def test_json_repair(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'Sure: {"a": "x}"} done': '{"a": "x}"}',
        '{"a": "cut off': '{"a": "cut off"}',
        '{"a": {"b": 1': '{"a": {"b": 1}}',
        '{"a": "line\nbreak"}': '{"a": "line\\nbreak"}',
        "[1]": None,
        "": None,
        "no json": None,
    }
    for raw, want in cases.items():
        assert T.repaired_object(raw) == want, raw
    assert T.repaired_object(None) is None
    assert one(spark, T.json_object(F.col("t")), t='{"b": 2, "a": 1}') == '{"a": 1, "b": 2}'


def test_scores_windows_and_codes(spark):
    for raw, want in ((None, 0), ("8", 8), ("15", 10), ("-3", 0), ("n/a", 0), ("7.6", 0)):
        assert one(spark, C.score_0_10(F.col("q")), q=raw) == want
    assert one(spark, C.score_0_10(F.col("q")), q=7.6) == 7
    assert C.clock_minutes("01:00-12:00") == (60, 720) and C.clock_minutes("late") == (None, None) and C.clock_minutes(None) == (None, None)
    for m, by_day, by_night in ((60, True, True), (720, False, False), (1330, False, True), (119, True, True), (120, True, False)):
        assert one(spark, C.in_window(F.col("m"), 60, 720), m=m) is by_day and one(spark, C.in_window(F.col("m"), 1320, 120), m=m) is by_night
    assert one(spark, C.in_window(F.col("m"), None, None), m=1) is True
    assert one(spark, C.countdown(F.col("s")), s=11229) == "3h 07m" and one(spark, C.countdown(F.col("s")), s=-1) == "now"
    assert one(spark, C.ramp(F.col("x"), 5.0, 5.0), x=1.0) == 1.0 and one(spark, C.ramp(F.col("x"), 0.0, 4.0), x=1.0) == 0.25
    got = one(spark, C.spec_parts(F.col("t")), t="m-1, LOW, 2000")
    assert (got.name, got.effort, got.cap) == ("m-1", "low", 2000)
    got = one(spark, C.spec_parts(F.col("t")), t="m, odd, x")
    assert (got.name, got.effort, got.cap) == ("m", None, None)
    assert one(spark, C.hamming(C.hex_code(F.col("a")), C.hex_code(F.col("b"))), a="F" * 16, b=" 0000000000000000") == 64
    assert one(spark, C.hex_code(F.col("a")), a="xyz") is None
    assert one(spark, C.content_key(F.col("a"), F.col("b")), a="1", b="2") != one(spark, C.content_key(F.col("a"), F.col("b")), a="12", b="")
    assert one(spark, C.place_line(F.col("a"), F.col("b")), a=None, b=None) is None
    assert one(spark, C.matches_any(F.col("a"), ["Timeout"]), a="read TIMEOUT") is True and one(spark, C.matches_any(F.col("a"), ["x"]), a=None) is False
