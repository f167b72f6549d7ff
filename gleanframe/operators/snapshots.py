"""What changed between full snapshots (problem 1).

Each snapshot is kept as an index in the shared folder: one entry (key, hash of the values) per
record, with the values beside it in columns that a probe does not read, cut into buckets by the
key. A new snapshot's entries probe the last index bucket by bucket, without an exchange; only for
keys whose hash differs are values fetched, again in place; then the new index takes the old one's
place.

Two forms share the entry and the probe rule:

* :class:`SnapshotStore` takes one snapshot at a time and keeps the last.
* :class:`NeighbourIndex` does all neighbouring pairs of a table that holds many snapshots in one
  pass: it writes the entries of every snapshot, bucketed by snapshot and key, and beside them the
  same entries under the snapshot that follows, which is the last index of that one.

Values compare null-safely: the hash covers null flags as well as values. The hash has 64 bits,
so two different value tuples of one key are mistaken for equal with probability 2**-64.
In the store keys may be null (null equals null); for the neighbours rows with a null key are no
records. Repeated keys inside one snapshot must be resolved first with :func:`latest_rows`. An empty
snapshot removes everything; a first snapshot reports nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.session import delete_path, scratch_path, shuffle_partitions
from gleanframe.sources.buckets import fields_of, read_bucketed, write_bucketed

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def value_hash(values: list[str]) -> Column:
    """64-bit hash of a tuple of columns and of which of them are null."""
    flags = [F.col(v).isNull() for v in values]
    return F.xxhash64(*flags, *[F.col(v) for v in values])


def latest_rows(df: DataFrame, by: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """One row per ``by``: the values of the row with the greatest ``order`` (nulls lowest).

    A partial aggregate runs before the shuffle, so a hot key sends one row per input partition.
    """
    kept = F.max_by(F.struct(*[F.col(v) for v in values]), F.struct(*order)).alias("__kept")
    return df.groupBy(*by).agg(kept).select(*by, *[F.col(f"__kept.`{v}`").alias(v) for v in values])


def key_hash(keys: list[str]) -> Column:
    """64-bit hash of a key and of which of its parts are null; keys that share it are told apart by the key itself."""
    return F.xxhash64(*[F.col(k).isNull() for k in keys], *[F.col(k) for k in keys])


def kind_of_change(old_hash: str, new_hash: str) -> Column:
    """``added``, ``removed`` or ``changed``; null where both hashes are the same."""
    return (
        F.when(F.col(old_hash).isNull(), ADDED)
        .when(F.col(new_hash).isNull(), REMOVED)
        .when(F.col(old_hash) != F.col(new_hash), CHANGED)
    )


def probe(old: DataFrame, new: DataFrame, by: list[str], same: list[str] | None = None) -> DataFrame:
    """Changes between two indexes: the columns of ``by`` and ``same``, and ``change_kind``.

    Entries meet where ``by`` is equal, which is how both are bucketed, and ``same`` is equal or
    null on both sides.
    """
    o, n = old.select(*by, *(same or []), "value_hash").alias("o"), new.select(*by, *(same or []), "value_hash").alias("n")
    both = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in by]
    both += [F.when(F.col("n.value_hash").isNull(), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in same or []]
    kind = kind_of_change("o.value_hash", "n.value_hash").alias("change_kind")
    return o.join(n, _meet("o", "n", by, same), "full_outer").select(*both, kind).where("change_kind is not null")


def _meet(left: str, right: str, by: list[str], same: list[str] | None) -> Column:
    """Equal in ``by``; in ``same`` equal or both null, said so that the planner takes ``by`` alone for the join's keys."""
    on = F.lit(True)
    for k in by:
        on = on & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    for k in same or []:
        a, b = F.col(f"{left}.{k}"), F.col(f"{right}.{k}")
        on = on & F.coalesce(a == b, a.isNull() & b.isNull())
    return on


def fetched(changes: DataFrame, old: DataFrame, new: DataFrame, by: list[str], same: list[str] | None, values: list[str]) -> DataFrame:
    """``changes`` with ``old_*`` and ``new_*`` values of the changed keys."""
    both = changes.alias("c").join(old.alias("o"), _meet("c", "o", by, same), "left").join(new.alias("n"), _meet("c", "n", by, same), "left")
    side = [F.col(f"{t}.{v}").alias(f"{name}_{v}") for t, name in (("o", "old"), ("n", "new")) for v in values]
    return both.select("c.*", *side)


def snapshot_order(df: DataFrame, snapshot: str) -> DataFrame:
    """The snapshots present with their neighbours: ``snapshot``, ``__before``, ``__after``."""
    w = Window.orderBy(snapshot)  # one row per snapshot, not per record
    present = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    return present.select(snapshot, F.lag(snapshot).over(w).alias("__before"), F.lead(snapshot).over(w).alias("__after"))


class NeighbourIndex:
    """The written indexes of all snapshots of ``df`` (one row per snapshot and key).

    ``order`` comes from :func:`snapshot_order` over all delivered rows, so a snapshot without valid
    records still counts as present. ``now`` holds the entries under their own snapshot, ``last``
    the same entries under the snapshot that follows.
    """

    def __init__(self, df: DataFrame, order: DataFrame, snapshot: str, keys: list[str], values: list[str]):
        spark = df.sparkSession
        self.by, self.values = [snapshot, *keys], values
        buckets, path = shuffle_partitions(spark), scratch_path(spark, "snapshots")
        order.coalesce(1).write.parquet(f"{path}/order")  # a row per snapshot
        order = spark.read.schema(order.schema).parquet(f"{path}/order")
        rows = df.select(*self.by, value_hash(values).alias("value_hash"), *values).where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.by))
        schema = fields_of(rows)
        # the rows come out of a grouping by snapshot and key, so they lie as the buckets do
        write_bucketed(rows, f"{path}/now", buckets, self.by)
        now = read_bucketed(spark, f"{path}/now", schema, buckets, self.by)
        after = now.join(order, snapshot).where("__after is not null").withColumn(snapshot, F.col("__after")).select(*rows.columns)
        write_bucketed(after.repartition(buckets, *self.by), f"{path}/last", buckets, self.by)
        self.last = read_bucketed(spark, f"{path}/last", schema, buckets, self.by)
        first = order.where("__before is null").first()  # probes nothing
        self.now = now if first is None else now.where(F.col(snapshot) != first[snapshot])

    def changes(self) -> DataFrame:
        """All changes between neighbouring snapshots: ``snapshot`` (the later), the keys, ``change_kind``."""
        return probe(self.last, self.now, self.by)

    def changes_with_values(self) -> DataFrame:
        """The same with ``old_*`` and ``new_*`` values, fetched in place for the changed keys."""
        return fetched(self.changes(), self.last, self.now, self.by, None, self.values)


class SnapshotStore:
    """Index and values of the last snapshot of one table, in a folder that all executors share.

    ``apply`` probes, fetches, writes the next version beside the last and then swaps by writing
    the pointer file, so a job that dies half-way leaves the last version in force.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.values, self.buckets = spark, path.rstrip("/"), keys, values, buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        root = self._fs_path(f"{self.path}/current")
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root))

    def current(self) -> str | None:
        """Folder of the version in force."""
        v = self._versions()
        return f"{self.path}/{v[-1]}" if v else None

    def apply(self, snapshot: DataFrame) -> DataFrame:
        """Changes against the version in force, with old and new values; then swap."""
        v = self._versions()
        last, name = self.current(), f"{len(v) and int(v[-1].split('-')[0]) + 1:09d}-{uuid.uuid4().hex[:8]}"
        here = f"{self.path}/{name}"
        rows = snapshot.select(key_hash(self.keys).alias("key_hash"), *self.keys, value_hash(self.values).alias("value_hash"), *self.values)
        schema = fields_of(rows)
        write_bucketed(rows.repartition(self.buckets, "key_hash"), f"{here}/index", self.buckets, ["key_hash"])
        read = lambda at: read_bucketed(self.spark, f"{at}/index", schema, self.buckets, ["key_hash"])
        new = read(here)
        old = new.where("false") if last is None else read(last)
        found = probe(old, new, ["key_hash"], self.keys)
        if last is None:
            found = found.where("false")
        changes = fetched(found, old, new, ["key_hash"], self.keys, self.values).drop("key_hash")
        changes.write.parquet(f"{here}/changes")
        self._fs.create(self._fs_path(f"{self.path}/current/{name}")).close()
        for x in v[:-1]:  # the version before stays for readers that still hold it
            delete_path(self.spark, f"{self.path}/{x}")
            delete_path(self.spark, f"{self.path}/current/{x}")
        return self.spark.read.schema(changes.schema).parquet(f"{here}/changes")
