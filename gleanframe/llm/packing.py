"""Filling fixed-capacity containers with items (problem 7).

Sizes are counted into a histogram with one entry per size up to the capacity. On it a
configuration linear program is solved: a variable per pattern (how many items of each size share a
container), as few containers as possible, every item covered. Multiplicative weights give the
duals: the price of a size is its length times a weight that shrinks by ``exp(-EPS * gain)`` whenever
a pattern covers a further share of it, normalised so that all items together keep their price;
sizes that lag behind are dear, and the next pattern takes them. Pricing finds the dearest pattern
by dynamic programming over the knapsack of the capacity, with no more of a size than is left. It
is partial: it looks at some of the dearest and smallest sizes, at more of them while that pattern
leaves room unused, and at all in the end.

Any prices, divided by the value of the dearest of all patterns, prove a lower bound on the
containers (:attr:`Plan.bound`): the first prices prove the bound by volume, the last ones may prove
more, and no two items above half the capacity share a container. Patterns may leave no more room
unused than the bound leaves. A pattern is used a whole number of times, at most a share of what its
scarcest size has left, so the fractional solution is rounded as it is built; what the patterns
leave is packed by first fit decreasing on the remaining counts. The program is solved with long
steps, and again with short ones (``STEPS``) until it meets its bound or the steps are used up; the
best solution stands.

A round takes its share of the scarcest size, so the rounds number about ``sizes * log(count)``
at most. Histogram, prices and patterns are bounded by the capacity, whatever the number of items;
capacities are solved in parallel tasks. The assignment runs on all rows in parallel: an item's
rank within its size names its pattern and container by arithmetic. Ranks are counted in slices of
about ``RANKED`` rows, as many as a size needs, so a hot size is spread over tasks.

An item larger than the capacity is split into full containers and one rest; no other item is
split. Items of size 0 are placed in container 0. Null sizes are not items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 0.02
#: Per attempt: share of the scarcest size's rest that a pattern may use, dearest and smallest sizes priced, items of one size among them.
STEPS = ((1.0, 24, 24, 1), (0.1, 64, 0, 3))
#: Rows of one size that one task ranks.
RANKED = 200_000


@dataclass
class Plan:
    """Containers by pattern: per size the ranges of item ranks and where they go."""

    capacity: int
    containers: int = 0
    bound: int = 0
    rounds: int = 0
    starts: dict[int, list[int]] = field(default_factory=dict)
    bases: dict[int, list[int]] = field(default_factory=dict)
    each: dict[int, list[int]] = field(default_factory=dict)
    filled: dict[int, int] = field(default_factory=dict)

    def use(self, pattern: dict[int, int], times: int) -> None:
        for size, a in pattern.items():
            at = self.filled.get(size, 0)
            self.starts.setdefault(size, []).append(at)
            self.bases.setdefault(size, []).append(self.containers)
            self.each.setdefault(size, []).append(a)
            self.filled[size] = at + times * a
        self.containers += times

    def arrays(self) -> dict[str, np.ndarray]:
        """Flat arrays: sizes, how many ranges each has, and the ranges."""
        sizes = sorted(self.starts)
        flat = {k: np.array([x for s in sizes for x in d[s]], np.int64) for k, d in (("starts", self.starts), ("bases", self.bases), ("each", self.each))}
        return {"sizes": np.array(sizes, np.int64), "ranges": np.array([len(self.starts[s]) for s in sizes], np.int64)} | flat


def price_pattern(units: np.ndarray, value: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Most valuable pattern within ``room`` with at most ``most`` items of each size.

    A size of many items is offered in lots of 1, 2, 4, ... and a rest, so the knapsack is over
    lots that are taken or not, one vector step each.
    """
    lots_of, lots = [], []
    most = np.minimum(most, room // units)
    lot = 1
    remaining = most.copy()
    while (remaining > 0).any():
        at = np.flatnonzero(remaining > 0)
        lots_of.append(at)
        lots.append(np.minimum(lot, remaining[at]))
        remaining[at] -= lots[-1]
        lot *= 2
    if not lots:
        return np.zeros(len(units), np.int64)
    which, many = np.concatenate(lots_of), np.concatenate(lots)
    order = np.argsort(-units[which] * many, kind="stable")
    which, many = which[order], many[order]
    weight, worth = units[which] * many, value[which] * many
    best = np.zeros(room + 1)
    took = np.zeros((len(which), room + 1), bool)
    for i, (w, v) in enumerate(zip(weight.tolist(), worth.tolist(), strict=True)):
        if w <= room:
            with_it = best[: room + 1 - w] + v
            np.greater(with_it, best[w:], out=took[i, w:])
            np.maximum(with_it, best[w:], out=best[w:])
    counts, c = np.zeros(len(units), np.int64), room
    for i in range(len(which) - 1, -1, -1):
        if took[i, c]:
            counts[which[i]] += many[i]
            c -= weight[i]
    return counts


def lower_bound(sizes: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """Containers that any packing needs, proved by ``prices`` and the dearest of all patterns."""
    dearest = price_pattern(sizes, prices, counts, capacity) @ prices
    return float(counts @ prices / dearest) if dearest > 0 else 0.0


def configuration_plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, steps: tuple = STEPS) -> Plan:
    """Solve, round and complete the program for one capacity; without ``steps`` it is first fit alone."""
    order = np.argsort(sizes)
    sizes, counts = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
    # by volume, and by items of which no two share a container
    bound = max(-(-int(counts @ sizes) // capacity), int(counts[2 * sizes > capacity].sum()))
    if not len(steps):
        steps = ((0.0, 0, 0, 0),)
    best = None
    for step in steps if len(sizes) else ():
        plan = _attempt(sizes, counts, capacity, bound, *step)
        bound = plan.bound
        if best is None or plan.containers < best.containers:
            best = plan
        if best.containers <= bound:
            break
    best = best or Plan(capacity)
    best.bound = bound
    return best


def _attempt(sizes: np.ndarray, counts: np.ndarray, capacity: int, bound: int, share: float, dearest: int, smallest: int, few: int) -> Plan:
    plan = Plan(capacity, bound=bound)
    left, weight, volume = counts.copy(), np.ones(len(sizes)), counts @ sizes
    slack = bound * capacity - int(volume)  # room that even the best packing leaves unused
    while share and (left > 0).any():
        open_ = np.flatnonzero(left)
        dear = open_[np.argsort(-weight[open_], kind="stable")]
        for wider in (1, 8, len(open_)):
            at = np.unique(np.append(dear[: dearest * wider], open_[: smallest * wider]))
            every = len(at) == len(open_)
            a = price_pattern(sizes[at], sizes[at] * weight[at], left[at] if every else np.minimum(left[at], few), capacity)
            at, a = at[a > 0], a[a > 0]
            waste = capacity - int(a @ sizes[at])
            if waste == 0 or every:
                break
        if waste > slack:
            break
        times = max(1, int(share * int((left[at] // a).min())))
        times = min(times, slack // waste) if waste else times
        slack -= times * waste
        plan.use(dict(zip(sizes[at].tolist(), a.tolist(), strict=True)), times)
        plan.rounds += 1
        left[at] -= times * a
        weight[at] *= np.exp(-EPS * times * a / counts[at])
        weight *= volume / (counts @ (sizes * weight))
    if plan.rounds:
        plan.bound = max(bound, int(np.ceil(lower_bound(sizes, counts, sizes * weight, capacity) - 1e-6)))
    rest = {s: n for s, n in zip(sizes.tolist(), left.tolist(), strict=True) if n}
    descending = sorted(rest, reverse=True)
    while descending:
        space, pattern = capacity, {}
        for s in descending:
            if (many := min(rest[s], space // s)) > 0:
                pattern[s] = many
                space -= many * s
        times = min(rest[s] // a for s, a in pattern.items())
        plan.use(pattern, times)
        for s, a in pattern.items():
            rest[s] -= times * a
        descending = [s for s in descending if rest[s]]
    return plan


# ---- rows
def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Every item for every container kind: ``container``, ``capacity``, ``item``, ``piece``, ``start``, ``size``."""
    kinds = containers.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0")
    # kinds are a handful of settings; the union below scans the written sizes once per kind
    rows = items.where("size is not null and size >= 0")
    every = None
    for r in kinds.collect():
        one = rows.select(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).alias("capacity"), "item", F.col("size").alias("whole"))
        every = one if every is None else every.unionByName(one)
    if every is None:
        every = rows.select(F.lit(None).cast("string").alias("container"), F.lit(1).cast("bigint").alias("capacity"), "item", F.col("size").alias("whole")).limit(0)
    last = F.greatest(F.lit(0), F.ceil(F.col("whole") / F.col("capacity")) - 1)
    cut = every.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece") * F.col("capacity")
    return cut.select("container", "capacity", "item", "piece", start.alias("start"), F.least(F.col("capacity"), F.col("whole") - start).alias("size"))


_PLAN = "container string, capacity bigint, containers bigint, bound bigint, rounds bigint, sizes array<bigint>, ranges array<bigint>, starts array<bigint>, bases array<bigint>, each array<bigint>"


def solved(histogram: DataFrame, steps: tuple = STEPS) -> DataFrame:
    """A row per container kind with its plan, from ``container``, ``capacity``, ``size``, ``n``; a task solves one kind."""

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        plan = configuration_plan(part["size"].to_numpy(), part["n"].to_numpy(), int(key[1]), steps)
        row = {"container": key[0], "capacity": key[1], "containers": plan.containers, "bound": plan.bound, "rounds": plan.rounds}
        return pd.DataFrame([row | plan.arrays()])

    # a histogram has at most ``capacity`` rows
    return histogram.where("size > 0").groupBy("container", "capacity").applyInPandas(solve, _PLAN)


def pack(items: DataFrame, containers: DataFrame, steps: tuple = STEPS) -> tuple[DataFrame, dict[str, Plan]]:
    """Assign ``items`` (``item``, ``size``) to containers of every kind (``container``, ``capacity_tokens``).

    ``items`` is read more than once and should be a written table. Result: ``container``, ``bin``
    (from 0), ``item``, ``piece``, ``start``, ``size``; and the plans.
    """
    spark = items.sparkSession
    rows = pieces(items, containers)
    histogram = rows.groupBy("container", "capacity", "size").agg(F.count("*").alias("n"))
    plans: dict[str, Plan] = {}
    lookup: dict[str, list[np.ndarray]] = {}
    # a row per kind, its arrays bounded by the capacity
    for r in solved(histogram, steps).collect():
        plans[r["container"]] = Plan(r["capacity"], r["containers"], r["bound"], r["rounds"])
        sizes, ranges, *flat = (np.array(r[k], np.int64) for k in ("sizes", "ranges", "starts", "bases", "each"))
        ends = np.cumsum(ranges)
        place = np.full(r["capacity"] + 1, -1)
        place[sizes] = np.arange(len(sizes))
        lookup[r["container"]] = [place, ends - ranges, ends, *flat]
    # sizes of many rows are ranked in slices; the slices' offsets are running sums per size
    slices = histogram.select("container", "size", F.ceil(F.col("n") / RANKED).cast("int").alias("slices"))
    rows = rows.join(slices, ["container", "size"]).withColumn("slice", F.pmod(F.xxhash64("item", "piece"), "slices").cast("int")).drop("slices")
    counts = rows.groupBy("container", "size", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("container", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("container", "size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    w = Window.partitionBy("container", "size", "slice").orderBy("item", "piece")
    ranked = rows.withColumn("rank", F.row_number().over(w) - 1).join(offsets, ["container", "size", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))
    sent = spark.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), np.int64)
            rank, size = b["rank"].to_numpy(np.int64), b["size"].to_numpy(np.int64)
            for kind, at in b.groupby("container").indices.items():
                place, first, last, starts, bases, each = sent.value[kind]
                at = at[size[at] > 0]
                k = place[size[at]]
                lo, hi = first[k], last[k]
                while (hi - lo > 1).any():  # the last range of the size that starts at or below the rank
                    mid = (lo + hi) // 2
                    up = (hi - lo > 1) & (starts[np.minimum(mid, len(starts) - 1)] <= rank[at])
                    lo, hi = np.where(up, mid, lo), np.where(up | (hi - lo <= 1), hi, mid)
                out[at] = bases[lo] + (rank[at] - starts[lo]) // each[lo]
            yield b[["container", "item", "piece", "start", "size"]].assign(bin=out)

    kind = items.schema["item"].dataType.simpleString()
    fields = f"container string, item {kind}, piece bigint, start bigint, size bigint, bin bigint"
    placed = ranked.select("container", "rank", "item", "piece", "start", "size").mapInPandas(run, fields)
    return placed.select("container", "bin", "item", "piece", "start", "size"), plans
