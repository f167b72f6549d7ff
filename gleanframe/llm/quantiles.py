"""Percentiles of very large numeric columns with a known rank error (problem 6).

A summary of a group is a list of tuples (value, least rank, greatest rank) in the order of the
values: deterministic rank intervals. From exact values the intervals are points. Merging adds to
each tuple's bounds what the other summaries prove about it: their ranks at or below it, and their
ranks up to their next tuple. Compression drops tuples as long as no gap (greatest rank of a tuple
minus least rank of the one before) exceeds ``2 * eps * n``; each level of the merge hierarchy may
use a larger part of ``eps``. Half the largest gap is the summary's proven rank error, which is
carried along and reported, so summaries of days, files or partitions combine at any time.

Summaries are built inside the input partitions before any shuffle, so a hot group sends one
bounded summary per partition, and are merged in a tree. A summary may be written and merged with
others later. Merges of many groups run as one sort and a few running sums.
Null, NaN and excluded values are no measurements; a group without any has no row. Values are
compared as doubles (whole numbers above 2**53 are rounded).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.session import shuffle_partitions

EPS = 0.001
#: Part of ``eps`` that summaries of partitions may use; the levels of the merge share the rest evenly.
FIRST = 0.4
#: Summaries of one group that are merged at once; a group of more goes up a tree, level by level.
FAN_IN = 16
_ROWS_HELD = 1_000_000
SUMMARY = "n bigint, v array<double>, lo array<bigint>, hi array<bigint>"


def _starts(a: np.ndarray) -> np.ndarray:
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return np.flatnonzero(new)


class Summaries:
    """Summaries of many groups: flat arrays, cut by ``offsets``."""

    def __init__(self, n, offsets, v, lo, hi):
        self.n, self.offsets, self.v, self.lo, self.hi = n, offsets, v, lo, hi

    @classmethod
    def exact(cls, group: np.ndarray, value: np.ndarray) -> Summaries:
        """From plain values; ``group`` counts from 0 and every group has a value."""
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        offsets = np.append(_starts(g), len(g))
        n = np.diff(offsets)
        rank = np.arange(len(g)) - np.repeat(offsets[:-1], n) + 1
        return cls(n, offsets, v, rank, rank.copy())

    def merged(self, group: np.ndarray) -> Summaries:
        """One summary per group; ``group`` (from 0, each present) tells where each summary goes."""
        sizes = np.diff(self.offsets)
        own = np.repeat(np.arange(len(sizes)), sizes)
        first = self.offsets[:-1][own] == np.arange(len(own))
        last = self.offsets[1:][own] == np.arange(len(own)) + 1
        # what passing a tuple adds to the proven ranks at or below, and to those up to the next
        low = np.where(first, self.lo, self.lo - np.roll(self.lo, 1))
        up = np.where(last, self.n[own] + 1, np.roll(self.hi, -1)) - self.hi
        head = np.zeros(group.max() + 1, np.int64)
        np.add.at(head, group, self.hi[self.offsets[:-1]] - 1)
        total = np.zeros(len(head), np.int64)
        np.add.at(total, group, self.n)
        g = group[own]
        order = np.lexsort((self.v, g))
        g, v, low, up, own_hi = g[order], self.v[order], low[order], up[order], None
        offsets = np.append(_starts(g), len(g))
        run = np.repeat(np.arange(len(total)), np.diff(offsets))
        within = lambda x: np.cumsum(x) - np.repeat((np.cumsum(x) - x)[offsets[:-1]], np.diff(offsets))
        lo, passed = within(low), within(up) - up
        return Summaries(total, offsets, v, lo, 1 + head[run] + passed)

    def compressed(self, eps: float) -> Summaries:
        """With tuples dropped as far as gaps of ``2 * eps * n`` allow; ends stay."""
        keep = np.ones(len(self.v), bool)
        for i in np.flatnonzero((np.diff(self.offsets) > 2) & (2 * eps * self.n >= 2)):
            a, b = self.offsets[i], self.offsets[i + 1]
            lo, hi, room, at = self.lo[a:b], self.hi[a:b], 2 * eps * self.n[i], 0
            stay = [0]
            while at < len(lo) - 1:
                at = max(at + 1, int(np.searchsorted(hi, lo[at] + room, side="right")) - 1)
                stay.append(min(at, len(lo) - 1))
            keep[a:b] = False
            keep[a + np.array(stay)] = True
        counts = np.add.reduceat(keep, self.offsets[:-1]) if len(self.n) else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return Summaries(self.n, offsets, self.v[keep], self.lo[keep], self.hi[keep])

    def arrow(self) -> list[pa.Array]:
        lists = [pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(x)) for x in (self.v, self.lo.astype(np.int64), self.hi.astype(np.int64))]
        return [pa.array(self.n.astype(np.int64)), *lists]

    @classmethod
    def from_arrow(cls, batch: pa.RecordBatch | pa.Table) -> Summaries:
        col = lambda c: pa.concat_arrays(x.chunks) if isinstance(x := batch.column(c), pa.ChunkedArray) else x
        v, lo, hi = (col(c) for c in ("v", "lo", "hi"))
        offsets = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (v, lo, hi)]
        return cls(col("n").to_numpy(zero_copy_only=False), offsets, *flat)


def _codes(batch: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row (nulls form groups) and a row of each group."""
    frame = batch.select(keys).to_pandas()
    code = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()  # in order of appearance
    row = np.empty(code.max() + 1, np.int64)
    row[code[::-1]] = np.arange(len(code))[::-1]
    return code, row


def _out(batch: pa.Table, keys: list[str], rows: np.ndarray, s: Summaries, slot: int | None) -> pa.RecordBatch:
    cols = {k: batch.column(k).take(pa.array(rows)) for k in keys}
    if slot is not None:
        cols["slot"] = pa.array(np.full(len(rows), slot, np.int32))
    cols |= dict(zip(("n", "v", "lo", "hi"), s.arrow(), strict=True))
    return pa.table(cols).combine_chunks().to_batches()[0]


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def slot_count(spark: SparkSession) -> int:
    """Slots that the partitions' summaries are dealt to, following the session's own measure of its size."""
    return max(64, shuffle_partitions(spark))


def summarise(df: DataFrame, keys: list[str], value: Column, eps: float = EPS) -> DataFrame:
    """Summaries of ``value`` per ``keys`` and input partition: the keys, ``slot``, and a summary."""
    slots = slot_count(df.sparkSession)
    rows = df.select(*keys, value.cast("double").alias("value")).where("value is not null and not isnan(value)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() % slots
        held: list[pa.RecordBatch] = []

        def fold() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            code, row = _codes(t, keys)
            s = Summaries.exact(code, t.column("value").to_numpy())
            return _out(t, keys, row, s.compressed(eps * FIRST), slot)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= _ROWS_HELD:
                yield fold()
                held.clear()
        if held:
            yield fold()

    return rows.mapInArrow(run, f"{_key_fields(df, keys)}, slot int, {SUMMARY}")


def regroup(df: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """Summaries merged inside each partition by new ``keys`` (for keys that a join brought in)."""
    slots = slot_count(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, held, tuples = TaskContext.get().partitionId() % slots, [], 0

        def fold() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            code, row = _codes(t, keys)
            return _out(t, keys, row, Summaries.from_arrow(t).merged(code).compressed(eps * FIRST), slot)

        for b in batches:
            if b.num_rows:
                held.append(b)
                tuples += len(b.column("v").flatten())
            if tuples >= _ROWS_HELD:
                yield fold()
                held, tuples = [], 0
        if held:
            yield fold()

    return df.select(*keys, "n", "v", "lo", "hi").mapInArrow(run, f"{_key_fields(df, keys)}, slot int, {SUMMARY}")


def merge(df: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """One summary per group from any summaries (``slot`` tells them apart, if there is one), merged in a tree of ``FAN_IN``.

    Each level sends the summaries of ``FAN_IN`` neighbouring slots of a group to one place, so a hot
    group is spread over tasks; there are as many levels as the slots need. Summaries
    read from a file are merged like any others.
    """
    slots = slot_count(df.sparkSession)
    if "slot" not in df.columns:
        df = df.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int"))
    levels = 1
    while FAN_IN**levels < slots:
        levels += 1
    for i in range(1, levels + 1):
        df = df.withColumn("slot", F.lit(0) if i == levels else F.floor(F.col("slot") / FAN_IN).cast("int"))
        df = _merged_level(df, keys, eps * (FIRST + (1 - FIRST) * i / levels))
    return df.drop("slot")


def _merged_level(df: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """One summary per ``keys`` and ``slot``. Groups are streamed in key order; a task holds an Arrow batch and one group."""
    by = [*keys, "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows of one group, from the batches before
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            ends = t.slice(0, 1) if not held else pa.concat_tables([held[-1].slice(0, 1), t.slice(0, 1)])
            if held and _codes(ends, by)[0][-1] > 0:  # another group begins
                yield fold(pa.concat_tables(held))
                held = []
            code, _ = _codes(t, by)
            cut = int(np.searchsorted(code, code[-1]))  # the last group may go on in the next batch
            if cut:
                yield fold(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield fold(pa.concat_tables(held))

    def fold(t: pa.Table) -> pa.RecordBatch:
        code, row = _codes(t, by)
        return _out(t, by, row, Summaries.from_arrow(t).merged(code).compressed(eps), None)

    rows = df.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by)
    return rows.select(*by, "n", "v", "lo", "hi").mapInArrow(run, f"{_key_fields(df, keys)}, slot int, {SUMMARY}")


def percentiles(df: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles from merged summaries: the keys, ``n``, one column per share, ``rank_error``.

    The value of share p is one whose rank differs from ceil(p * n) by at most ``rank_error``,
    half of the summary's largest gap, rounded up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, "n"]].copy()
            got: dict[str, list] = {name: [] for name in shares}
            error = []
            for n, v, lo, hi in zip(b["n"], b["v"], b["lo"], b["hi"], strict=True):
                for name, p in shares.items():
                    rank = max(1, int(np.ceil(p * n)))
                    got[name].append(float(v[int(np.argmin(np.maximum(rank - lo, hi - rank)))]))
                gap = int((hi[1:] - lo[:-1]).max()) if len(v) > 1 else 0
                error.append(max(0, -(-gap // 2) if gap > 1 else 0))
            yield out.assign(**got, rank_error=np.array(error, np.int64))

    fields = ", ".join(f"{name} double" for name in shares)
    return df.mapInPandas(run, f"{_key_fields(df, keys)}, n bigint, {fields}, rank_error bigint")
