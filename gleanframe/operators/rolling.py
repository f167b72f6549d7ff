"""Rolling totals over trailing periods (problem 4).

Rows are reduced to one per entity and day, range-free hash-partitioned by entity and sorted by
day; a partition is one stream. Per entity a two-stack queue holds the active window: the back
stack is the running aggregate since the last flip, the front stack the suffix aggregates of the
days before it. The queue flips when its back holds a whole window, so every result is one combine
of front and back. Nothing is subtracted, hence any monoid will do (sum, count, maximum, ...).
The flips fall on every w-th day of an entity, so all queues of an Arrow batch run in lockstep as
rows of one numpy grid.

Days without a row are filled between an entity's first and last day. Null measures count as the
monoid's identity. Rows without a day have no place on the calendar and are left out; a null
entity is an entity of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that are filled at once; an entity's own days are bounded by the calendar.
DAYS_AT_ONCE = 500_000
_LOW = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Measure:
    """One trailing aggregate: ``kind`` is ``sum``, ``max``, ``min`` or ``count`` of bigint ``column``."""

    name: str
    column: str
    kind: str = "sum"

    def lift(self, values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if self.kind == "count":
            return known.astype(np.int64)
        return np.where(known, values, self.identity)

    @property
    def identity(self) -> int:
        return {"sum": 0, "count": 0, "max": _LOW, "min": -_LOW - 1}[self.kind]

    @property
    def combine(self) -> np.ufunc:
        return {"sum": np.add, "count": np.add, "max": np.maximum, "min": np.minimum}[self.kind]


def two_stack(values: np.ndarray, window: int, combine: np.ufunc, identity: int) -> np.ndarray:
    """Trailing aggregates over ``values`` (a stream that starts with an empty queue)."""
    n = len(values)
    grid = np.full((-(-n // window), window), identity, np.int64)
    grid.ravel()[:n] = values
    back = combine.accumulate(grid, axis=1)
    front = combine.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    # at place i of a run the front still holds places i + 1 .. of the run before
    held = np.full_like(grid, identity)
    held[1:, :-1] = front[:-1, 1:]
    return combine(back, held).ravel()[:n]


def _runs(entity: pd.Series) -> np.ndarray:
    """Starts of the runs of equal entities, nulls equal."""
    codes = pd.factorize(entity, use_na_sentinel=False)[0]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _emit(rows: pd.DataFrame, entity: str, windows: tuple[int, ...], measures: tuple[Measure, ...]) -> pd.DataFrame:
    starts = _runs(rows[entity])
    ends = np.append(starts[1:], len(rows))
    day = rows["__day"].to_numpy(np.int64)
    length = day[ends - 1] - day[starts] + 1
    offset = np.concatenate([[0], np.cumsum(length)])
    which = np.repeat(np.arange(len(starts)), length)
    since = np.arange(offset[-1]) - offset[which]
    row_of = np.repeat(np.arange(len(starts)), ends - starts)
    slot = offset[row_of] + day - day[starts][row_of]
    out = {entity: rows[entity].to_numpy(object)[starts][which], "__day": day[starts][which] + since}
    for w in windows:
        out[f"days_{w}"] = np.minimum(since + 1, w)
        # every entity starts a new run of the grid after one run of identities
        pad = (-(-length // w) + 1) * w
        at = np.concatenate([[0], np.cumsum(pad)])
        place = at[which] + w + since
        for m in measures:
            col = rows[m.column]
            known = col.notna().to_numpy()
            lifted = np.full(at[-1], m.identity, np.int64)
            lifted[place[slot]] = m.lift(col.fillna(0).to_numpy(np.int64), known)
            got = two_stack(lifted, w, m.combine, m.identity)[place]
            out[f"{m.name}_{w}"] = pd.array(got, dtype="Int64")
            if m.kind in ("max", "min"):
                out[f"{m.name}_{w}"][got == m.identity] = pd.NA
    return pd.DataFrame(out)


def _emitted(rows: pd.DataFrame, entity: str, windows: tuple[int, ...], measures: tuple[Measure, ...]) -> Iterator[pd.DataFrame]:
    """:func:`_emit` for as many entities at a time as fill ``DAYS_AT_ONCE`` days, whatever days they span."""
    starts = _runs(rows[entity])
    ends = np.append(starts[1:], len(rows))
    day = rows["__day"].to_numpy(np.int64)
    length = day[ends - 1] - day[starts] + 1
    a = 0
    while a < len(starts):
        b = a + max(1, int(np.searchsorted(np.cumsum(length[a:]), DAYS_AT_ONCE, side="right")))
        yield _emit(rows.iloc[starts[a] : ends[b - 1]].reset_index(drop=True), entity, windows, measures)
        a = b


def trailing(
    df: DataFrame, entity: str, day: str, windows: tuple[int, ...], measures: tuple[Measure, ...]
) -> DataFrame:
    """For each entity and calendar day from its first to its last, every measure over every window.

    ``df`` has one row per entity and day and bigint measure columns. Result: ``entity``, ``day``,
    and for each window w ``days_w`` (days of the window since the entity's first) and
    ``<measure>_w``; maxima and minima are null where the window has no value.
    """
    used = list(dict.fromkeys(m.column for m in measures))
    kind = df.schema[entity].dataType.simpleString()
    rows = df.where(F.col(day).isNotNull()).select(
        entity, F.unix_date(F.col(day).cast("date")).alias("__day"), *[F.col(c).cast("bigint").alias(c) for c in used]
    )
    rows = rows.repartition(F.col(entity)).sortWithinPartitions(entity, "__day")
    fields = [f"`{entity}` {kind}", "__day bigint"]
    for w in windows:
        fields += [f"days_{w} bigint", *[f"{m.name}_{w} bigint" for m in measures]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            if not len(b):
                continue
            cut = _runs(b[entity])[-1]  # the last entity may go on in the next batch
            kept = b.iloc[cut:]
            if cut:
                yield from _emitted(b.iloc[:cut].reset_index(drop=True), entity, windows, measures)
        if kept is not None and len(kept):
            yield from _emitted(kept.reset_index(drop=True), entity, windows, measures)

    out = rows.mapInPandas(run, ", ".join(fields))
    names = [c for c in out.columns if c not in (entity, "__day")]
    return out.select(entity, F.date_from_unix_date(F.col("__day").cast("int")).alias(day), *names)
