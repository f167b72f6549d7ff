"""Operators on ordered rows: islands, bursts, streaks, budgets, walk-back.

All take ``by``, columns that part the rows into independent sequences; a sequence is one window
partition. Only where the meaning needs one order over everything is ``by`` empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.scalars import hamming
from gleanframe.session import scratch_path


def islands(df: DataFrame, by: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """``name``: number of the run, from 1, that begins wherever ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def bursts(df: DataFrame, by: list[str], order: str, code: str, near: int, most: int) -> DataFrame:
    """Runs of rows each within ``near`` bits of the row before, cut after every ``most`` rows.

    Adds ``burst`` (number inside ``by``), ``place`` (from 0) and ``head`` (first row's order value).
    A null code is near to nothing.
    """
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("__last", F.lag(code).over(w))
    df = islands(df, by, [F.col(order)], ~F.coalesce(hamming(F.col(code), F.col("__last")) <= near, F.lit(False)), "__island")
    inside = Window.partitionBy(*by, "__island").orderBy(order)
    df = df.withColumn("__at", F.row_number().over(inside) - 1).withColumn("place", F.col("__at") % most)
    df = df.withColumn("burst", F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).over(w))
    df = df.withColumn("head", F.first(order).over(Window.partitionBy(*by, "burst").orderBy(order)))
    return df.drop("__last", "__island", "__at")


def bursts_with_aux(df: DataFrame, by: list[str], order: str, code: str, aux: Column, near: int, most: int) -> DataFrame:
    """As :func:`bursts`, where ``aux`` rows neither join nor break a run.

    An aux row belongs to the burst in progress, leading ones to the first burst; a sequence of aux
    rows alone has burst null.
    """
    df = df.withColumn("__aux", F.coalesce(aux, F.lit(False)))
    members = bursts(df.where(~F.col("__aux")), by, order, code, near, most)
    rest = df.where(F.col("__aux"))
    for c in ("place", "burst", "head"):
        rest = rest.withColumn(c, F.lit(None).cast(members.schema[c].dataType))
    every = members.unionByName(rest)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    burst = F.coalesce(F.last("burst", True).over(before), F.first("burst", True).over(after))
    return every.withColumn("burst", burst).drop("__aux")


def bursts_by_head(df: DataFrame, by: str, order: str, code: str, near: int, near_head: int, most: int) -> DataFrame:
    """Bursts in which a row may also join by being within ``near_head`` bits of the burst's head.

    That makes each decision depend on the ones before, so a sequence is folded in order by one
    task, batch after batch; rows are hash-partitioned by ``by``. Adds ``burst``.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", burst bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple | None = None  # sequence, burst, head, last, members
        for b in batches:
            out = np.empty(len(b), np.int64)
            for i, (key, c) in enumerate(zip(b[by], b[code].astype(object), strict=True)):
                x = None if pd.isna(c) else int(c) & (2**64 - 1)
                if state is None or state[0] != key:
                    state = (key, 1, x, x, 1)
                else:
                    _, burst, head, last, size = state
                    close = x is not None and (
                        (last is not None and (x ^ last).bit_count() <= near) or (head is not None and (x ^ head).bit_count() <= near_head)
                    )
                    state = (key, burst, head, x, size + 1) if close and size < most else (key, burst + 1, x, x, 1)
                out[i] = state[1]
            yield b.assign(burst=out)

    return df.where(F.col(by).isNotNull()).repartition(F.col(by)).sortWithinPartitions(by, order).mapInPandas(run, fields)


def streaks(df: DataFrame, by: list[str], order: list[Column], miss: Column) -> DataFrame:
    """``streak``: how many misses in a row end here; a hit sets it back to 0."""
    df = df.withColumn("__miss", F.coalesce(miss, F.lit(False)))
    df = islands(df, by, order, ~F.col("__miss"), "__run")
    w = Window.partitionBy(*by, "__run").orderBy(*order)
    return df.withColumn("streak", F.sum(F.col("__miss").cast("int")).over(w)).drop("__miss", "__run")


def spent_before(df: DataFrame, by: list[str], order: list[Column], cost: Column, name: str = "spent_before") -> DataFrame:
    """Cost of all earlier rows of the sequence, 0 for the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(cost).over(w), F.lit(0)))


def walk_back(df: DataFrame, by: list[str], order: str, good: Column) -> DataFrame:
    """``outcome``: rows before the first good one are ``retired``, it is ``winner``, later ones ``open``.

    The first good row is one aggregate per sequence, so nothing is scanned in order.
    """
    first = df.where(good).groupBy(*by).agg(F.min(order).alias("__first"))
    joined = df.join(first, by, "left") if by else df.withColumn("__first", first.scalar())
    outcome = (
        F.when(F.col("__first").isNull() | (F.col(order) < F.col("__first")), "retired")
        .when(F.col(order) == F.col("__first"), "winner")
        .otherwise("open")
    )
    return joined.withColumn("outcome", outcome).drop("__first")


def head_ranks(known: DataFrame, fresh: DataFrame, key: str, rank: str, order: list[Column], part: Column) -> DataFrame:
    """Ranks for unknown rows, directly below the lowest known one (below 0 at first), oldest lowest.

    ``part`` grows with the order and has few values (a day, say): rows are counted per part first and
    numbered inside parts, so no task sees all rows.
    """
    new = fresh.join(known.select(key), key, "left_anti")
    base = known.agg(F.least(F.lit(0), F.coalesce(F.min(rank), F.lit(0)))).scalar()
    parts = new.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = parts.withColumn("__at", at).join(starts.select("__part", "__before"), "__part")
    total = new.agg(F.count("*")).scalar()
    return numbered.withColumn(rank, base - total + F.col("__before") + F.col("__at") - 1).drop("__part", "__before", "__at")


def first_per_phase(df: DataFrame, key: str, phase: Column, order: list[Column]) -> DataFrame:
    """Each key once, in the first phase and place where it occurs; adds ``phase``."""
    df = df.withColumn("phase", phase)
    rest = [c for c in df.columns if c != key]
    kept = F.min_by(F.struct(*rest), F.struct(F.col("phase"), *order)).alias("__kept")
    return df.groupBy(key).agg(kept).select(key, *[F.col(f"__kept.`{c}`").alias(c) for c in rest])


def or_else(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """``rows``, or ``fallback`` where there are none; the test is a scalar of the plan."""
    empty = rows.limit(1).agg(F.count("*") == 0).scalar()
    return rows.unionByName(fallback.where(empty))


def positions(rows: DataFrame, order: list[Column], out: str, slices: int = 64) -> DataFrame:
    """``rows`` with ``out``, the place (from 1) in the order of all rows; ``order`` tells all rows apart.

    Rows are cut into ranges of the order and written with their places inside the range, so that all
    later steps see the same ranges; the ranges' offsets are added at the end. No task holds all rows.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(slices, *order).withColumn("__range", F.spark_partition_id())
    inside = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    inside.write.parquet(path := scratch_path(spark, "places"))
    inside = spark.read.schema(inside.schema).parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = inside.groupBy("__range").agg(F.max("__in").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return inside.join(offsets, "__range").withColumn(out, F.col("__base") + F.col("__in")).drop("__range", "__in", "__base")


def positional(stored: DataFrame, actual: DataFrame, key: str, windows: tuple[int, int], most_misses: int, slice_: int = 1_000_000) -> DataFrame:
    """How stored places (``stored``, 1 to the number of rows) lead to actual ones (``actual``).

    The drift is actual minus stored place; the one of the last row found before shifts where a row is
    looked for. ``found`` tells the window that reaches it: ``near``, ``wide`` or ``far``; a row that is
    nowhere is ``gone``, but ``kept`` once more than ``most_misses`` rows in a run are missed. The walk runs in
    slices of places; the last hit of the slices before is carried into each.
    """
    near, wide = (w // 2 for w in windows)
    rows = stored.join(actual, key, "left").withColumn("__drift", F.col("actual") - F.col("stored"))
    rows = rows.withColumn("__slice", F.floor(F.col("stored") / slice_))
    hit = F.when(F.col("__drift").isNotNull(), F.struct("stored", F.col("__drift").alias("drift")))
    over = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    carried = rows.groupBy("__slice").agg(F.max(hit).alias("__last")).select("__slice", F.last("__last", ignorenulls=True).over(over).alias("__carried"))
    before = Window.partitionBy("__slice").orderBy("stored").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__seen", F.last(hit, ignorenulls=True).over(before)).join(carried, "__slice")
    rows = rows.withColumn("__seen", F.coalesce("__seen", "__carried"))
    learned, missed = F.coalesce("__seen.drift", F.lit(0)), F.col("__drift").isNull()
    rows = rows.select(key, "__drift", learned.alias("learned"), F.when(missed, F.col("stored") - F.coalesce("__seen.stored", F.lit(0))).otherwise(0).alias("misses"))
    off = F.abs(F.col("__drift") - F.col("learned"))
    found = F.when(missed & (F.col("misses") > most_misses), "kept").when(missed, "gone").when(off <= near, "near").when(off <= wide, "wide").otherwise("far")
    return rows.select(key, found.alias("found"), "learned", "misses")


def curve(rows: DataFrame, key: str, slice_: Column, order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``gained`` (the value less the one before it, 0 where either is unknown) and ``reading`` (its number), per key in order.

    ``slice_`` ascends with the order: a hot key is walked slice by slice in many tasks, and what the
    slices before end with is carried into each.
    """
    cut = rows.withColumn("__slice", slice_)
    w = Window.partitionBy(key, "__slice").orderBy(*order)
    ends = cut.groupBy(key, "__slice").agg(F.count("*").alias("__n"), F.max_by(F.struct(value), F.struct(*order)).alias("__end"))
    over = Window.partitionBy(key).orderBy("__slice")  # a row per slice of the key
    ends = ends.select(key, "__slice", F.lag("__end").over(over).alias("__before"), F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    cut = cut.withColumns({"__lag": F.lag(F.struct(value)).over(w), "__in": F.row_number().over(w)}).join(ends, [key, "__slice"])
    last = F.coalesce("__lag", "__before")[value]
    return cut.withColumns({"gained": F.coalesce(F.col(value) - last, F.lit(0)), "reading": (F.col("__base") + F.col("__in")).cast("int")}).drop("__slice", "__lag", "__in", "__before", "__base")
