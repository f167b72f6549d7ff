"""Seams for outside models and services: injected functions over Arrow batches.

A client is a picklable factory called once per task; what it returns maps a batch of inputs to a
list of answers. Calls are looked up in a response cache first, repeated inputs of a batch are asked
once, passing errors are tried again with growing waits, and what still fails becomes the given
answer: a refusing one (closed) or a letting one (open).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.scalars import clamped, index_or_zero, one_based, score_0_10
from gleanframe.sources.logs import ResponseCache

#: Response codes after which another try cannot help.
FINAL_CODES = (400, 401, 403, 404, 408, 413, 422)


def passing(error: Exception) -> bool:
    """Whether another try may help: not after a final response code, nor a wrong value or type."""
    code = getattr(error, "status_code", None) or getattr(error, "code", None)
    if isinstance(code, int):
        return code not in FINAL_CODES
    return not isinstance(error, (ValueError, TypeError, KeyError))


def tried(call: Callable, batch: list, attempts: int, base: float, factor: float, longest: float, sleep: Callable = time.sleep) -> list:
    """``call(batch)``, again after passing errors, at most ``attempts`` times; the last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return list(call(batch))
        except Exception as error:
            if k == attempts or not passing(error):
                raise
            sleep(min(base * factor ** (k - 1), longest))
    return []


def asked(
    factory: Callable[[], Callable[[list], list]],
    inputs: Column,
    on_failure: str | None,
    attempts: int = 3,
    base: float = 1.0,
    factor: float = 2.0,
    longest: float = 30.0,
) -> Column:
    """The client's answers as a string column; null inputs and failed batches get ``on_failure``."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = factory()
        for b in batches:
            wanted = b.dropna().drop_duplicates()
            try:
                got = dict(zip(wanted, tried(call, wanted.tolist(), attempts, base, factor, longest), strict=True)) if len(wanted) else {}
            except Exception:
                got = {}
            yield b.map(lambda x, got=got: got.get(x, on_failure))

    return ask(inputs)


def asked_through_cache(df: DataFrame, cache: ResponseCache, key: Column, factory: Callable, inputs: Column, out: str, on_failure: str | None) -> DataFrame:
    """``df`` with ``out``: cached answers, and for misses one call per distinct key, which is then stored.

    A failure is never stored, so it is asked again the next time.
    """
    from gleanframe.session import scratch_path

    spark, failed = df.sparkSession, "\x00failed"
    keyed = df.withColumn("__k", key).withColumn("__in", inputs)
    misses = cache.lookup(keyed.select("__k", "__in").dropDuplicates(["__k"]), F.col("__k")).where("response is null")
    path = scratch_path(spark, "answers")
    misses.select(F.col("__k").alias("key"), asked(factory, F.col("__in"), failed).alias("response")).write.parquet(path)
    fresh = spark.read.parquet(path)
    cache.put(fresh.where(F.col("response") != failed))
    hits = cache.lookup(keyed, F.col("__k"))
    return hits.withColumn(out, F.coalesce("response", F.lit(on_failure))).drop("__k", "__in", "response")


# ---- answers with parts
def decided(factory: Callable[[], Callable[[list], list]], inputs: Column, fields: str, fallback: dict, attempts: int = 3, base: float = 1.0, factor: float = 2.0, longest: float = 30.0) -> Column:
    """The client's answers as a struct of ``fields`` and ``ok``.

    ``inputs`` may be any column, also a list (several pictures of one question). The client maps a
    list of inputs to a list of dicts, or ``None`` where it has no answer. Null inputs, missing answers and
    failed batches give ``fallback`` with ``ok`` false: a fallback that refuses makes the decision
    closed, one that lets pass makes it open.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(f"{fields}, ok boolean")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = factory()
        for b in batches:
            there = b[b.notna()]
            try:
                got = dict(zip(there.index, tried(call, there.tolist(), attempts, base, factor, longest), strict=True)) if len(there) else {}
            except Exception:
                got = {}
            rows = [(got.get(i) or None) for i in b.index]
            yield pd.DataFrame([{**{n: (fallback if r is None else r).get(n) for n in names}, "ok": r is not None} for r in rows], columns=[*names, "ok"], index=b.index)

    return ask(inputs)


def group_verdict(answer: Column, members: Column) -> Column:
    """A group's verdict from an answer with ``safe``, ``interesting``, ``score`` (text) and ``best`` (index), refusing where it is not ``ok``.

    The score is cut to 0 .. 10, the index moved into the group.
    """
    ok = F.coalesce(answer["ok"], F.lit(False))
    yes = lambda c: ok & F.coalesce(c, F.lit(False))
    return F.struct(
        yes(answer["safe"]).alias("safe"),
        yes(answer["interesting"]).alias("interesting"),
        F.when(ok, score_0_10(answer["score"])).otherwise(0).alias("score"),
        F.when(F.size(members) > 0, clamped(F.coalesce(answer["best"], F.lit(0)), F.size(members))).alias("best"),
        ok.alias("ok"),
    )


def same_scene(answer: Column, when_unknown: bool) -> Column:
    """Whether two pictures show one scene; unknown answers follow the caller: no duplicate (open) or a new scene (closed)."""
    return F.when(F.coalesce(answer["ok"], F.lit(False)), F.coalesce(answer["same"], F.lit(when_unknown))).otherwise(F.lit(when_unknown))


def gate_then_ask(df: DataFrame, gate: Column, inputs: Column, out: str, factory: Callable, fields: str, fallback: dict) -> DataFrame:
    """``df`` with ``out``: true or false where the cheap ``gate`` decides, else the client's ``yes``; only undecided rows are asked."""
    asked_ = decided(factory, F.when(F.col("__gate").isNull(), F.col("__in")), fields, fallback)
    rows = df.withColumns({"__gate": gate, "__in": inputs}).withColumn("__answer", asked_)
    return rows.withColumn(out, F.coalesce("__gate", F.col("__answer.yes"))).drop("__gate", "__in", "__answer")


def picked(candidates: Column, answer: Column, most: int = 8) -> Column:
    """The candidate that the picker names among the first ``most`` distinct, non-empty ones, in their order.

    A single candidate needs no picker; an index out of range names the first; without candidates null.
    """
    shown = shown_candidates(candidates, most)
    at = F.when(F.size(shown) > 1, index_or_zero(F.coalesce(answer, F.lit(-1)), F.size(shown))).otherwise(F.lit(0))
    return F.get(shown, at.cast("int"))


def shown_candidates(candidates: Column, most: int = 8) -> Column:
    """The first ``most`` distinct candidates that hold more than blanks."""
    trimmed = F.transform(F.coalesce(candidates, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), 1, most)


def turn_order(name: Column, turns: tuple[int, ...] = (0, 90, 180, 270)) -> Column:
    """The turns in an order that follows from the name alone: sorted by a digest of name and turn."""
    keyed = F.array(*[F.struct(F.md5(F.concat_ws("/", F.coalesce(name, F.lit("")), F.lit(str(t)))).alias("k"), F.lit(t).alias("turn")) for t in turns])
    return F.transform(F.array_sort(keyed), lambda x: x["turn"])


def chosen_turn(name: Column, pick: Column, confirmed: Column, turns: tuple[int, ...] = (0, 90, 180, 270)) -> Column:
    """The turn behind a pick (1 to 4) in the shown order; without a pick or a confirmation nothing is turned."""
    at = one_based(pick, F.lit(len(turns)))
    return F.when(F.coalesce(confirmed, F.lit(False)) & at.isNotNull(), F.get(turn_order(name, turns), at.cast("int"))).otherwise(F.lit(0))


class Capabilities:
    """Named functions of a column; unknown names are told apart and applied as no change."""

    def __init__(self, **functions: Callable[[Column], Column]):
        self.functions = functions

    def unknown(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in self.functions]

    def applied(self, names: list[str], c: Column) -> Column:
        for n in names:
            c = self.functions.get(n, lambda x: x)(c)
        return c


def prepared(steps: list[tuple[str, Column, str]], otherwise: str = "approved") -> Column:
    """A struct of ``state`` and ``step`` of an ordered chain: the first step whose check holds gives its state and ends the chain."""
    state, step = F.when(F.lit(False), F.lit(otherwise)), F.when(F.lit(False), F.lit(""))
    for name, check, then in steps:
        hit = F.coalesce(check, F.lit(False))
        state, step = state.when(hit, F.lit(then)), step.when(hit, F.lit(name))
    return F.struct(state.otherwise(F.lit(otherwise)).alias("state"), step.alias("step"))
