"""Joins by key, by nearness and against few references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.scalars import cosine, hamming

SHARD_CODES = 1_048_576
PART_CODES = 131_072
_PAIRS_AT_ONCE = 1_000_000
_QUARTER = np.arange(1 << 16, dtype=np.uint16)


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The whole latest row of every key."""
    rest = [c for c in df.columns if c != key]
    kept = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__kept")
    return df.groupBy(key).agg(kept).select(key, *[F.col(f"__kept.`{c}`").alias(c) for c in rest])


def membership(rows: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with boolean ``out``: whether the key is among ``ids``; null keys never are."""
    there = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__there", F.lit(True))
    return rows.join(there, key, "left").withColumn(out, F.coalesce("__there", F.lit(False))).drop("__there")


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys, ``n`` and the exact ``median`` of a whole-number column, from counts per value.

    Values are counted before the shuffle, and the middle is found on running counts: a task goes once
    over a group's distinct values in order and holds none of them.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__upto", F.sum("__c").over(w))
    sums = counts.groupBy(*keys).agg(F.sum("__c").alias("n"))
    both = counts.alias("c").join(sums.alias("s"), [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    at = lambda r: F.min(F.when(F.col("__upto") >= r, F.col(value)))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    return both.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "n").agg(((at(lower) + at(upper)) / 2).alias("median"))


def undecided(catalog: DataFrame, ledger: DataFrame, key: str, decided: Column, revive: Column | None = None) -> DataFrame:
    """Catalog rows without a decided ledger row, or whose decision ``revive`` takes back.

    The ledger is reduced to its blocking keys first, so the join is one anti join whatever the rule.
    """
    blocking = decided if revive is None else decided & ~F.coalesce(revive, F.lit(False))
    return catalog.join(ledger.where(blocking).select(key), key, "left_anti")


def band_pairs(code: Column, near: int) -> Column:
    """(number of a pair of bands, the pair's bits) of a 64-bit code; codes within ``near`` bits share at least one.

    ``near`` changed bits touch at most ``near`` of ``near + 2`` bands, so two bands are the same. Pairs are
    twice as wide as single bands, so far fewer codes meet by chance.
    """
    n = near + 2
    cuts = [64 * i // n for i in range(n + 1)]
    part = lambda i: F.shiftright(code, 64 - cuts[i + 1]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1).cast("bigint"))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    return F.array(*[F.struct(F.lit(k).alias("pair"), F.shiftleft(part(i), 32).bitwiseOR(part(j)).alias("bits")) for k, (i, j) in enumerate(pairs)])


def near_semi(probe: DataFrame, kept: DataFrame, code: str, near: int) -> DataFrame:
    """Probe rows whose ``code`` lies within ``near`` bits of any kept code.

    Distinct codes meet in shared pairs of bands (an equi-join) and are compared there; a code that many rows
    hold is compared once.
    """
    a = probe.select(F.col(code).alias("a")).where("a is not null").distinct()
    b = kept.select(F.col(code).alias("b")).where("b is not null").distinct()
    a = a.select("a", F.inline(band_pairs(F.col("a"), near)))
    b = b.select("b", F.inline(band_pairs(F.col("b"), near)))
    hits = a.join(b, ["pair", "bits"]).where(hamming(F.col("a"), F.col("b")) <= near).select(F.col("a").alias(code)).distinct()
    return probe.join(hits, code, "left_semi")


def _earliest(queries: np.ndarray, nodes: np.ndarray, at: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries with a node within ``near`` bits, and the least ``at`` of those nodes.

    Codes are cut into four quarters with radii that add up to ``near`` - 3: if every quarter differed
    in more than its radius, the codes would differ in more than ``near`` bits. So a near node is found
    by one of its quarters, looked up under every change of the query's quarter within the radius.
    """
    got_q, got_at = [np.empty(0, np.int64)], [np.empty(0, at.dtype)]
    for i in range(4):
        radius = (near + 1) // 4 - 1 + (i < (near + 1) % 4)
        quarter = lambda codes: (codes >> np.uint64(48 - 16 * i)).astype(np.uint16)  # noqa: B023, E731
        keys = quarter(nodes)
        order = np.argsort(keys, kind="stable")
        codes, ats = nodes[order], at[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << 16))])
        asked = quarter(queries)
        for change in _QUARTER[np.bitwise_count(_QUARTER).astype(int) <= radius]:
            lo = starts[(run := (asked ^ change).astype(np.int64))]
            count = starts[run + 1] - lo
            some = np.flatnonzero(count)
            held = np.cumsum(count[some])
            cuts = np.searchsorted(held, np.arange(_PAIRS_AT_ONCE, (held[-1] if len(held) else 0) + _PAIRS_AT_ONCE, _PAIRS_AT_ONCE)) + 1
            for part in np.split(some, np.minimum(cuts, len(some))[:-1]):
                c = count[part]
                q = np.repeat(part, c)
                place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - lo[part], c)
                hit = np.bitwise_count(queries[q] ^ codes[place]) <= near
                got_q.append(q[hit])
                got_at.append(ats[place[hit]])
    q, first = np.concatenate(got_q), np.concatenate(got_at)
    order = np.lexsort((first, q))
    q, first = q[order], first[order]
    head = np.flatnonzero(np.diff(q, prepend=-1))
    return q[head], first[head]


def near_earlier(rows: DataFrame, kept: Column, code: str, at: str, near: int) -> DataFrame:
    """Rows whose ``code`` lies within ``near`` bits of that of any ``kept`` row with a lower ``at``.

    Each distinct code is searched once, for the least ``at`` of the kept rows near it; shards of
    kept codes meet parts of the codes in question.
    """
    spread = F.xxhash64(code)
    coded = rows.where(F.col(code).isNotNull() & F.col(at).isNotNull())
    codes = coded.groupBy(code).agg(F.min(F.when(kept, F.col(at)).cast("bigint")).alias("since"))
    n = codes.count()
    shards, parts = max(1, -(-n // SHARD_CODES)), max(-(-n // PART_CODES), min(24, -(-n // 2048)), 1)
    nodes = codes.where("since is not null").withColumn("shard", F.pmod(spread, F.lit(shards)))
    nodes = nodes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    asked = codes.select(code, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("bigint").alias("part"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        as_bits = lambda df: df[code].to_numpy(np.int64).view(np.uint64)
        q, since = _earliest(as_bits(right), as_bits(left), left["since"].to_numpy(np.int64), near)
        return pd.DataFrame({code: right[code].to_numpy()[q], "since": since})

    meet = nodes.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part"))
    found = meet.applyInPandas(run, f"{code} bigint, since bigint").groupBy(code).agg(F.min("since").alias("since"))
    return coded.join(found, code).where(F.col("since") < F.col(at)).drop("since")


def best_reference(rows: DataFrame, references: DataFrame, id_: str, vector: str) -> DataFrame:
    """Largest cosine of each row's vector with any reference, and the first reference that has it.

    References are few by definition; they are collected into one array row and read as a
    scalar, so every vector is read once and nothing is multiplied out.
    """
    few = references.select(F.struct(F.col(id_).alias("ref"), F.col(vector).cast("array<double>").alias("v")).alias("r"))
    few = few.agg(F.sort_array(F.collect_list("r")).alias("refs"))
    scored = rows.withColumn("__refs", few.scalar()).select(
        id_,
        F.transform("__refs", lambda r: F.struct(cosine(F.col(vector).cast("array<double>"), r["v"]).alias("sim"), (-r["ref"]).alias("minus"))).alias("s"),
    )
    best = F.array_max("s")
    return scored.select(id_, best["sim"].alias("similarity"), (-best["minus"]).alias("reference"))


def with_default(rows: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with a dimension in which missing keys take default values."""
    return rows.join(dimension, key, "left").na.fill(defaults)
