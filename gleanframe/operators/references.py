"""References to records that do not exist (problem 3).

Keys are placed on the range of their 64-bit hash and range-partitioned, parents and references
alike. A partition first keeps its parents as sorted arrays, then probes each Arrow batch of
references by binary search; what does not stand comes out.

Parents stand in spans of months (first month at whose end they stand, last such month). Both
sides are aggregated before the range shuffle (a parent to its spans, a reference to key and
month), so a key that holds a third of the rows costs as much as any other. The text of the key is
compared after the hash, and keys that share a hash are told apart, so the result is exact.

There are as many ranges as keep the parents of one at about ``RANGE_BYTES``.

Null keys are not references and not parents; a null month (no arrival time) is never reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.session import estimated_bytes, shuffle_partitions

#: Months are numbered from year 0 and take 20 bits; this one stands for "still standing".
OPEN = (1 << 20) - 1
#: Bytes of parents that a range may hold, and the most ranges.
RANGE_BYTES, MOST_RANGES = 256 << 20, 20_000


def parent_spans(df: DataFrame, relation: str, key: Column, first: Column, last: Column | None = None) -> DataFrame:
    """Parents of ``relation``: one row per key and first month, with the last month it stands."""
    end = F.lit(OPEN) if last is None else F.coalesce(last, F.lit(OPEN))
    spans = df.select(key.alias("key"), first.cast("int").alias("month"), end.cast("int").alias("until"))
    spans = spans.where("key is not null and month is not null and until >= month")
    return spans.groupBy("key", "month").agg(F.max("until").alias("until")).select(F.lit(relation).alias("relation"), "key", "month", "until")


def reference_months(df: DataFrame, relation: str, key: Column, month: Column) -> DataFrame:
    """References of ``relation``: one row per key and month with the number of referring rows."""
    refs = df.select(key.alias("key"), month.cast("int").alias("month")).where("key is not null and month is not null")
    return refs.groupBy("key", "month").agg(F.count("*").alias("n")).select(F.lit(relation).alias("relation"), "key", "month", "n")


class _Range:
    """The sorted parent arrays of one key range."""

    def __init__(self, parts: list[pd.DataFrame]):
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"place": [], "key": [], "month": [], "until": []})
        place, key = rows["place"].to_numpy(np.int64), rows["key"].to_numpy(object)
        new = np.ones(len(rows), bool)
        new[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        self.group_place, self.group_key = place[new], key[new]
        self.starts = (group << 20) | rows["month"].to_numpy(np.int64)
        # running maximum inside each key: the group number leads, so it never carries over
        self.ends = np.maximum.accumulate((group << 20) | rows["until"].to_numpy(np.int64)) & OPEN
        self.group = group
        shared = self.group_place[1:][self.group_place[1:] == self.group_place[:-1]]
        at = np.flatnonzero(np.isin(self.group_place, shared))
        self.shared = {(self.group_place[g], self.group_key[g]): g for g in at.tolist()}

    def stands(self, place: np.ndarray, key: np.ndarray, month: np.ndarray) -> np.ndarray:
        if not len(self.group_place):
            return np.zeros(len(place), bool)
        g = np.minimum(np.searchsorted(self.group_place, place), len(self.group_place) - 1)
        known = self.group_place[g] == place
        if self.shared:
            for i in np.flatnonzero(known):
                g[i] = self.shared.get((place[i], key[i]), g[i])
        known &= self.group_key[g] == key
        at = np.searchsorted(self.starts, (g << 20) | month, side="right") - 1
        known &= (at >= 0) & (self.group[at] == g)
        return known & (self.ends[at] >= month)


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parents: list[pd.DataFrame] = []
    ranges: _Range | None = None
    for b in batches:
        is_ref = b["is_ref"].to_numpy(bool)
        if not is_ref.all():
            parents.append(b.loc[~is_ref, ["place", "key", "month", "until"]])
        if is_ref.any():
            ranges = ranges or _Range(parents)
            refs = b[is_ref]
            ok = ranges.stands(refs["place"].to_numpy(np.int64), refs["key"].to_numpy(object), refs["month"].to_numpy(np.int64))
            yield refs.loc[~ok, ["relation", "key", "month", "n"]]


def orphans(parents: DataFrame, references: DataFrame) -> DataFrame:
    """References for whose month no parent of the same relation and key stands.

    ``relation``, ``key``, ``month``, ``n`` (referring rows). Parents come from
    :func:`parent_spans`, references from :func:`reference_months`; several relations may be
    united and share the one range shuffle.
    """
    place = F.xxhash64("relation", "key")
    cols = ["relation", "key", "month"]
    p = parents.select(F.lit(False).alias("is_ref"), place.alias("place"), *cols, "until", F.lit(0).cast("bigint").alias("n"))
    r = references.select(F.lit(True).alias("is_ref"), place.alias("place"), *cols, F.lit(0).alias("until"), "n")
    # a task holds the parents of its range, so the ranges follow the parents' size as the planner knows it
    n = max(shuffle_partitions(parents.sparkSession), min(MOST_RANGES, estimated_bytes(parents) // RANGE_BYTES))
    # signed order of the hash, cut into n equal ranges
    at = F.shiftright(F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-(2**63)).cast("bigint")), 33) * F.lit(n), 31).cast("int")
    both = p.unionByName(r).repartitionById(n, at)
    both = both.sortWithinPartitions("is_ref", "place", "key", "month")
    return both.mapInPandas(_probe, "relation string, key string, month int, n bigint")
