"""State tables as pure functions (state, changes) -> state, and a store that commits by swap.

Plain Parquet has no update in place; a mutation is a keyed join and a new version. Keys compare
null-safely in no function here: rows with a null key never match and pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.session import delete_path


def last_per_key(changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last change of every key; partial aggregation runs before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    kept = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__kept")
    return changes.groupBy(key).agg(kept).select(key, *[F.col(f"__kept.`{c}`").alias(c) for c in rest])


def first_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of every key."""
    rest = [c for c in rows.columns if c != key]
    kept = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__kept")
    return rows.groupBy(key).agg(kept).select(key, *[F.col(f"__kept.`{c}`").alias(c) for c in rest])


def upsert(state: DataFrame, changes: DataFrame, key: str, overwrite: list[str], add: list[str] = ()) -> DataFrame:
    """Insert new keys; for known ones overwrite (also by null) or add up the named columns, keep the rest."""
    s, c = state.alias("s"), changes.withColumn("__there", F.lit(True)).alias("c")
    known, changed = F.col(f"s.{key}").isNotNull(), F.col("c.__there").isNotNull()
    out = []
    for name in state.columns:
        old = F.col(f"s.`{name}`")
        new = F.col(f"c.`{name}`") if name in changes.columns else F.lit(None)
        if name == key:
            value = F.coalesce(old, new)
        elif name in add:
            value = F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
        elif name in overwrite:
            value = F.when(changed, new).otherwise(old)
        else:
            value = F.when(known, old).otherwise(new)
        out.append(value.alias(name))
    return s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full_outer").select(*out)


def insert_ignore(state: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with unknown keys are added, the first of each key; known keys stay untouched."""
    fresh = first_per_key(rows, key, order).join(state.select(key), key, "left_anti")
    return state.unionByName(fresh.select(*state.columns))


def update_given(state: DataFrame, updates: DataFrame, key: str, allowed: list[str] | None = None) -> DataFrame:
    """Columns of matching rows replaced where the update gives a value; only those ``allowed``, if told. Lists, maps and structs become JSON."""
    given = [c for c in updates.columns if c != key and (allowed is None or c in allowed)]
    nested = {f.name for f in updates.schema if f.dataType.typeName() in ("array", "map", "struct")}
    u = updates.select(key, *[(F.to_json(F.col(f"`{c}`")) if c in nested else F.col(f"`{c}`")).alias(f"__new_{c}") for c in given])
    cols = [F.coalesce(F.col(f"__new_{c}"), F.col(f"`{c}`")).alias(c) if c in given else F.col(f"`{c}`") for c in state.columns]
    return state.join(u, key, "left").select(*cols)


def moved(state: DataFrame, column: str, from_: str, to: str) -> DataFrame:
    """Every row in one state moved to another."""
    return state.withColumn(column, F.when(F.col(column) == from_, to).otherwise(F.col(column)))


def ensured(state: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """``state``, and the ``defaults`` of the keys that it lacks."""
    return state.unionByName(defaults.join(state.select(key), key, "left_anti").select(*state.columns))


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose row a change altered or removed."""
    rest = [c for c in before.columns if c != key]
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"b.`{c}`").eqNullSafe(F.col(f"a.`{c}`"))
    a = after.withColumn("__there", F.lit(True)).alias("a")
    return before.alias("b").join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "left").where(F.col("a.__there").isNull() | ~same).select(f"b.{key}")


def without(state: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``gone``."""
    return state.join(gone.select(key), key, "left_anti").select(*state.columns)


def marked_gone(state: DataFrame, gone: DataFrame, key: str, changes: dict[str, Column], most: int) -> DataFrame:
    """``changes`` applied to the rows whose key is gone, unless more than ``most`` rows are hit.

    The guard is a scalar of the same plan, so nothing is collected.
    """
    flags = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    hit = state.join(flags, key, "left")
    few = hit.agg(F.count("__gone") <= most).scalar()
    act = F.col("__gone") & few
    cols = [F.when(act, changes[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in state.columns]
    return hit.select(*cols)


def filled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Empty or blank texts replaced by ``value``."""
    return rows.withColumn(column, F.coalesce(F.when(F.trim(F.col(column)) != "", F.col(column)), value))


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


class VersionedTable:
    """A table whose versions are folders; the newest committed one is in force.

    A version is committed by a marker file written after its rows, so readers see whole versions
    only and a failed write leaves the last one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        root = self._p(f"{self.path}/committed")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/{v[-1]}") if v else None

    def commit(self, df: DataFrame, keep: int = 2) -> DataFrame:
        self.commit_by(df.write.parquet, keep)
        return self.read()

    def commit_by(self, write: Callable[[str], object], keep: int = 2) -> None:
        """Commit what ``write`` puts below the path that it gets."""
        v = self.versions()
        number = int(v[-1].split("-")[0]) + 1 if v else 0
        name = f"{number:09d}-{uuid.uuid4().hex[:8]}"
        write(f"{self.path}/{name}")
        self._fs.create(self._p(f"{self.path}/committed/{name}")).close()
        for old in v[: max(0, len(v) + 1 - keep)]:
            delete_path(self.spark, f"{self.path}/committed/{old}")
            delete_path(self.spark, f"{self.path}/{old}")


class VersionedTables:
    """Several tables that change together: a version holds all of them and one marker commits it.

    A run that dies between two tables leaves the last version in force for both.
    """

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...]):
        self.names, self._one = names, VersionedTable(spark, path)

    def read(self) -> dict[str, DataFrame] | None:
        v = self._one.versions()
        return {n: self._one.spark.read.parquet(f"{self._one.path}/{v[-1]}/{n}") for n in self.names} if v else None

    def commit(self, tables: dict[str, DataFrame], keep: int = 2) -> dict[str, DataFrame]:
        self._one.commit_by(lambda at: [tables[n].write.parquet(f"{at}/{n}") for n in self.names], keep)
        return self.read()
