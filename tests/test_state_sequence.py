from pyspark.sql import functions as F

from gleanframe.operators import lookup, sequence, state


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_upsert_keeps_adds_and_overwrites(spark):
    s = spark.createDataFrame([("a", 1, "x", 5), ("b", 2, "y", None)], "k string, n int, why string, kept int")
    c = spark.createDataFrame([("b", 3, None, 9), ("c", 1, "z", 8)], "k string, n int, why string, kept int")
    got = state.upsert(s, c, "k", ["why"], ["n"])
    assert rows(got, "k", "n", "why", "kept") == [("a", 1, "x", 5), ("b", 5, None, None), ("c", 1, "z", 8)]
    assert state.upsert(s.limit(0), c, "k", ["why"]).count() == 2 and state.upsert(s, c.limit(0), "k", ["why"]).count() == 2


def test_insert_ignore_first_wins(spark):
    s = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    assert rows(state.insert_ignore(s, new, "k", [F.col("v")]), "k", "v") == [("a", 1), ("b", 2)]


def test_guard_stops_mass_changes(spark):
    s = spark.createDataFrame([(str(i), "posted") for i in range(6)] + [(None, "posted")], "k string, st string")
    gone = spark.createDataFrame([("1",), ("2",), ("2",), ("9",)], "k string")
    for most, hit in ((2, 2), (1, 0)):
        got = state.marked_gone(s, gone, "k", {"st": F.lit("rejected")}, most)
        assert got.where("st = 'rejected'").count() == hit and got.count() == 7


def test_versioned_table_swaps(spark, tmp_path):
    t = state.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    for i in range(4):
        t.commit(spark.range(i))
    assert t.read().count() == 3 and len(t.versions()) == 2


def test_bursts_spill_over_the_cap_and_aux_rows(spark):
    same = [(1, i, 0b1111, False) for i in range(6)]
    df = spark.createDataFrame(same + [(2, 0, None, True), (2, 1, 1, False), (2, 2, -1, False), (2, 3, None, True), (3, 0, 5, True)], "g int, o int, c bigint, aux boolean")
    got = sequence.bursts(df.where("g = 1"), ["g"], "o", "c", 8, 3)
    assert rows(got, "o", "burst", "place", "head") == [(i, i // 3 + 1, i % 3, i // 3 * 3) for i in range(6)]
    got = sequence.bursts_with_aux(df.where("g > 1"), ["g"], "o", "c", F.col("aux"), 8, 3)
    assert rows(got, "g", "o", "burst") == [(2, 0, 1), (2, 1, 1), (2, 2, 2), (2, 3, 2), (3, 0, None)]


def test_bursts_by_head_follow_the_head(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0b111), (1, 3, 0b1), (1, 4, -1), (1, 5, None)], "g int, o int, c bigint")
    got = sequence.bursts_by_head(df, "g", "o", "c", 1, 3, 9)
    assert rows(got, "o", "burst") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)]


def test_streaks_walk_back_and_ranks(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([True, True, False, None, True])], "g int, o int, m boolean")
    assert [r[1] for r in rows(sequence.streaks(df, ["g"], [F.col("o")], F.col("m")), "o", "streak")] == [1, 2, 0, 0, 1]
    got = sequence.walk_back(df, ["g"], "o", F.col("m") == False)  # noqa: E712
    assert [r[1] for r in rows(got, "o", "outcome")] == ["retired", "retired", "winner", "open", "open"]
    got = sequence.walk_back(df, [], "o", F.lit(False))
    assert {r.outcome for r in got.collect()} == {"retired"}
    known = spark.createDataFrame([(str(i), i) for i in range(5)], "k string, r bigint")
    fresh = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2), ("0", 9)], "k string, at int")
    got = sequence.head_ranks(known, fresh, "k", "r", [F.col("at")], F.col("at"))
    assert rows(got, "k", "r") == [("x", -1), ("y", -3), ("z", -2)]
    more = known.unionByName(got.select("k", "r"))
    again = sequence.head_ranks(more, spark.createDataFrame([("n", 7)], "k string, at int"), "k", "r", [F.col("at")], F.col("at"))
    assert rows(again, "k", "r") == [("n", -4)]


def test_undecided_and_revivable(spark):
    catalog = spark.createDataFrame([("low",), ("unsafe",), ("new",), ("old",)], "k string")
    ledger = spark.createDataFrame([("low", 1, "lowq", 6), ("unsafe", 1, "unsafe", None), ("old", 1, None, 9)], "k string, seen int, why string, score int")
    for bar, want in ((7, ["new"]), (6, ["low", "new"])):
        back = F.expr(f"why = 'lowq' and score >= {bar}")
        assert [r[0] for r in rows(lookup.undecided(catalog, ledger, "k", F.col("seen") == 1, back), "k")] == want


def test_near_semi_equals_nested_loop(spark):
    import random

    random.seed(1)
    kept = [random.getrandbits(64) for _ in range(60)]
    probe = [k ^ sum(1 << b for b in random.sample(range(64), n)) for n, k in enumerate(kept[:14])] + [None]
    signed = lambda x: None if x is None else x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(probe)], "i int, c bigint")
    b = spark.createDataFrame([(signed(x),) for x in kept], "c bigint")
    assert [r[0] for r in rows(lookup.near_semi(a, b, "c", 6), "i")] == list(range(7))


def test_best_reference_takes_the_first_of_equals(spark):
    refs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "id int, v array<double>")
    got = lookup.best_reference(spark.createDataFrame([(9, [3.0, 0.0]), (8, [0.0, 0.0])], "id int, v array<double>"), refs, "id", "v")
    assert rows(got, "id", "reference")[1] == (9, 1)
