"""Duplicates of new batches against all history (problem 2).

History is a set of segments, a segment is a set of shards, and a shard is a stored navigable
small-world graph over 64-bit picture fingerprints: every node (a distinct fingerprint) keeps the
list of its nearest other nodes and a few links to nodes far away; sixteen orders of the nodes, each
by the fingerprint rotated to start at another bit, give the entry points.

A search enters at the nodes next to the query on every order and then walks the links: it keeps
the nearest nodes seen so far (the beam), opens the nearest one not yet opened, looks at those of its
neighbours that it has not visited, and ends when all of the beam is open. How wide entry and beam
are is tuned when the shard is built: the smallest of ``WIDTHS`` whose recall against exhaustive
search of the shard, on a sample of altered nodes, reaches ``RECALL``; width and recall are kept with
the shard. The beam of a query that is full of hits is widened, doubling, until it is not, so a
query with many near nodes loses none to the width. Distances are exact, so a found pair is right;
a pair may be missed with a probability of about ``1 - RECALL``.

Segments follow the logarithmic method: a batch becomes a new segment, and compaction, a scheduled
call of its own, joins neighbours of equal span. :func:`duplicate_pairs` builds all segments that ever
serve as history of a table in one job, writes them to the shared folder and searches batch ``t`` in
the segments given by the binary digits of ``t``. :class:`GraphHistory` keeps them between runs.

A segment of more than ``SHARD_NODES`` nodes has several shards. While they are few, nodes go to them
by hash and a query visits all. Beyond that fingerprints are cut into bands of which, within
``max_bits``, a known number must agree; nodes and queries go to one cell for every choice of so
many bands, and the scheme with the fewest visits is taken, so the cells shrink as the segment
grows. Cells that are still too large are cut by hash; cells with many queries are searched by
several tasks. Cells are counted in the data, never assumed to be even.

The index is stored bucketed by shard and read in place: only queries are shuffled.

Equal fingerprints are one node, whatever the number of records behind it. Null or unusable
fingerprints are no nodes and no queries.
"""

from __future__ import annotations

import uuid
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.functions.timestamps import trim_space
from gleanframe.session import delete_path, scratch_path

MAX_BITS = 6
SHARD_NODES = 65_536
SHARD_QUERIES = 131_072
RECALL = 0.999
WIDTHS = (4, 8, 16, 32, 64, 128)
#: Nearest nodes and far nodes that a node links to, orders that give entries, places looked at on each side of an order.
NEAR_LINKS, FAR_LINKS, ORDERS, REACH = 12, 4, 16, 3
#: Altered nodes whose search is held against exhaustive search when a shard is tuned.
TUNING_QUERIES = 1_000
#: (bands, bands that are chosen): without bands, by one of seven, by two of eight, by three of nine.
SCHEMES = ((1, 0), (7, 1), (8, 2), (9, 3))
_VISITED_AT_ONCE = 1 << 25
_NONE = np.int64(1) << 60 | 1


# ---- spelling
def file_hash(c: Column) -> Column:
    """64 lower-case hex digits of a SHA-256, or null."""
    h = F.regexp_replace(F.lower(trim_space(c)), r"^(?:sha-?256\s*[:=]?\s*|0x)", "")
    return F.when(h.rlike("^[0-9a-f]{64}$"), h)


def picture_code(c: Column) -> Column:
    """A 64-bit fingerprint as bigint, or null where it is not exactly 16 hex digits."""
    h = F.regexp_replace(F.lower(trim_space(c)), r"^(?:p?hash\s*[:=]\s*|0x)", "")
    return F.when(h.rlike("^[0-9a-f]{16}$"), F.conv(h, 16, -10).try_cast("bigint"))


# ---- one shard
def _rotated(codes: np.ndarray, start: int) -> np.ndarray:
    return codes if start == 0 else (codes << np.uint64(start)) | (codes >> np.uint64(64 - start))


def _sorted_once(keys: np.ndarray) -> np.ndarray:
    """Rows in ascending order, repeated entries (but for the expanded bit) moved to the end; of a repeated one the expanded stays."""
    keys.sort(axis=1)
    again = np.zeros(keys.shape, bool)
    again[:, :-1] = keys[:, 1:] >> 1 == keys[:, :-1] >> 1
    again &= keys < _NONE
    if again.any():
        keys[again] = _NONE
        keys.sort(axis=1)
    return keys


class Shard:
    """A navigable small-world graph: ``links[i]`` are the nodes that node ``i`` links to."""

    def __init__(self, codes: np.ndarray, links: np.ndarray, orders: np.ndarray, width: int, recall: float, max_bits: int = MAX_BITS):
        self.codes, self.links, self.orders, self.width, self.recall, self.max_bits = codes, links, orders, width, recall, max_bits
        self.starts = [64 * r // len(orders) for r in range(len(orders))]
        self.keys = [_rotated(codes, s)[o] for s, o in zip(self.starts, orders, strict=True)]

    @classmethod
    def built(cls, codes: np.ndarray, max_bits: int = MAX_BITS, tune: bool = True) -> Shard:
        """The graph of distinct ``codes``, tuned against exhaustive search."""
        codes = np.sort(codes)
        n = len(codes)
        own = np.arange(n, dtype=np.int64)
        orders = np.stack([np.argsort(_rotated(codes, 64 * r // ORDERS), kind="stable").astype(np.int32) for r in range(ORDERS)])
        best = np.full((n, NEAR_LINKS), _NONE)
        for order in orders:
            seen, placed = [best], codes[order]
            for step in [s for w in range(1, min(REACH, n - 1) + 1) for s in (w, -w)]:
                other = np.roll(order, -step)
                key = np.empty(n, np.int64)
                key[order] = np.bitwise_count(placed ^ codes[other]).astype(np.int64) << 33 | other.astype(np.int64) << 1
                seen.append(key[:, None])
            best = _sorted_once(np.concatenate(seen, axis=1))[:, :NEAR_LINKS].copy()
        near = np.where(best >= _NONE, own[:, None], best >> 1 & 0xFFFFFFFF)
        far = np.random.default_rng(n).integers(0, max(n, 1), (n, FAR_LINKS))
        shard = cls(codes, np.concatenate([near, far], axis=1).astype(np.int32), orders, WIDTHS[0], 1.0, max_bits)
        if tune and n:
            shard.tune()
        return shard

    def tune(self, queries: np.ndarray | None = None) -> None:
        """Take the smallest width that reaches ``RECALL`` on ``queries`` (else: nodes with up to ``max_bits`` bits altered)."""
        rng = np.random.default_rng(len(self.codes))
        if queries is None:
            base = self.codes[rng.integers(0, len(self.codes), TUNING_QUERIES)]
            bits = np.argsort(rng.random((TUNING_QUERIES, 64)), axis=1)[:, : self.max_bits].astype(np.uint64)
            used = np.arange(self.max_bits) < rng.integers(1, self.max_bits + 1, TUNING_QUERIES)[:, None]
            queries = base ^ np.bitwise_or.reduce(np.where(used, np.uint64(1) << bits, np.uint64(0)), axis=1)
        truth = len(exhaustive(queries, self.codes, self.max_bits)[0])
        for self.width in WIDTHS:
            self.recall = len(self.search(queries)[0]) / truth if truth else 1.0
            if self.recall >= RECALL:
                return

    def entries(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The nodes next to each query on every order."""
        n, each = len(self.codes), max(1, width // 2)
        steps = np.arange(-each, each)
        out = []
        for start, order, keys in zip(self.starts, self.orders, self.keys, strict=True):
            at = np.searchsorted(keys, _rotated(queries, start))
            out.append(order[np.clip(at[:, None] + steps, 0, n - 1)])
        return np.concatenate(out, axis=1)

    def _walk(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The beam of each query after the walk: (distance, node, opened) packed in one number, nearest first."""
        seeds = self.entries(queries, width)
        each, n = np.arange(len(queries)), len(self.codes)
        visited = np.zeros((len(queries), n), bool)
        visited[each[:, None], seeds] = True
        far = np.bitwise_count(queries[:, None] ^ self.codes[seeds]).astype(np.int64)
        beam = np.full((len(queries), width), _NONE)
        got = _sorted_once(far << 33 | seeds.astype(np.int64) << 1)[:, :width]
        beam[:, : got.shape[1]] = got
        active = each
        while True:
            held = beam[active]
            shut = held & 1 == 0
            more = shut.any(axis=1)
            active, held = active[more], held[more]
            if not len(active):
                return beam
            rows, at = np.arange(len(active)), shut[more].argmax(axis=1)
            node = held[rows, at] >> 1 & 0xFFFFFFFF
            held[rows, at] |= 1
            to = self.links[node]
            new = ~visited[active[:, None], to]
            visited[active[:, None], to] = True
            far = np.bitwise_count(queries[active][:, None] ^ self.codes[to]).astype(np.int64)
            both = np.concatenate([held, np.where(new, far << 33 | to.astype(np.int64) << 1, _NONE)], axis=1)
            beam[active] = _sorted_once(both)[:, :width]

    def search(self, queries: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node fingerprint) of the pairs found within ``max_bits``, each once."""
        found_q, found_n = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        n = len(self.codes)
        todo, width = np.arange(len(queries) if n else 0), width or self.width
        while len(todo):
            full = []
            step = max(1, _VISITED_AT_ONCE // max(n, 64 * width))
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                beam = self._walk(queries[part], width)
                near = (beam >> 33) <= self.max_bits
                over = near[:, -1] & (width < n)
                full.append(part[over])
                row, col = np.nonzero(near & ~over[:, None])
                found_q.append(part[row])
                found_n.append(self.codes[beam[row, col] >> 1 & 0xFFFFFFFF])
            todo, width = np.concatenate(full), width * 2
        return np.concatenate(found_q), np.concatenate(found_n)

    def row(self) -> dict:
        """The shard as one row of flat arrays."""
        return {
            "nodes": len(self.codes), "width": self.width, "recall": self.recall,
            "codes": self.codes.tobytes(), "links": self.links.tobytes(), "orders": self.orders.tobytes(),
        }

    @classmethod
    def of_row(cls, row, max_bits: int = MAX_BITS) -> Shard:
        codes = np.frombuffer(row["codes"], np.uint64)
        arrays = [np.frombuffer(row[k], np.int32).reshape(shape) for k, shape in (("links", (len(codes), -1)), ("orders", (-1, len(codes))))]
        return cls(codes, *arrays, int(row["width"]), float(row["recall"]), max_bits)


def exhaustive(queries: np.ndarray, codes: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing each query with every node."""
    q, n = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for i, x in enumerate(queries):
        hit = codes[np.bitwise_count(codes ^ x) <= max_bits]
        q.append(np.full(len(hit), i))
        n.append(hit)
    return np.concatenate(q), np.concatenate(n)


# ---- cells of a segment
def scheme_of(nodes: int) -> int:
    """The scheme by which a query visits the fewest shards of a segment of so many nodes."""

    def visits(s: tuple[int, int]) -> int:
        return comb(*s) * max(1, -(-nodes // (SHARD_NODES << (64 // s[0] * s[1]))))

    return min(range(len(SCHEMES)), key=lambda i: (visits(SCHEMES[i]), i))


def _choices(scheme: int) -> Column:
    """(choice of bands, their bits) of a fingerprint, one for every choice."""
    bands, chosen = SCHEMES[scheme]
    cuts = [64 * i // bands for i in range(bands + 1)]
    out = []
    for i, choice in enumerate(combinations(range(bands), chosen)):
        cell = F.lit(0).cast("bigint")
        for b in choice:
            width = cuts[b + 1] - cuts[b]
            value = F.shiftright("code", 64 - cuts[b + 1]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            cell = F.shiftleft(cell, width).bitwiseOR(value)
        out.append(F.struct(F.lit(i).alias("choice"), cell.alias("cell")))
    return F.array(*out)


_CELL = ["level", "first", "choice", "cell"]


def _celled(df: DataFrame, schemes: dict[tuple[int, int], int]) -> DataFrame:
    """``df`` (``level``, ``first``, ``code``, ...) once for every choice of bands of its segment's scheme."""
    cases = None
    for s in sorted(set(schemes.values()) - {0}):
        segments = [f"{k}-{f}" for (k, f), x in schemes.items() if x == s]
        here = F.concat_ws("-", "level", "first").isin(segments)
        cases = F.when(here, _choices(s)) if cases is None else cases.when(here, _choices(s))
    return df.select("*", F.inline(_choices(0) if cases is None else cases.otherwise(_choices(0))))


def _shard_name(piece: Column) -> Column:
    return F.concat_ws("-", *_CELL, piece).alias("shard")


_SHARD = "shard string, nodes int, width int, recall double, codes binary, links binary, orders binary"


def build_index(nodes: DataFrame, sizes: dict[tuple[int, int], int], path: str, max_bits: int = MAX_BITS) -> None:
    """Write the graphs of all segments of ``nodes`` (``level``, ``first``, ``code``, distinct) below ``path``.

    ``sizes`` has the number of nodes of every segment, or more. ``<path>/cells`` says into how many
    shards each cell is cut, ``<path>/shards`` holds one row per shard, bucketed by shard.
    """
    spark = nodes.sparkSession
    schemes = {s: scheme_of(n) for s, n in sizes.items()}
    placed = _celled(nodes, schemes)
    cells = placed.groupBy(*_CELL).agg(F.ceil(F.count("*") / F.lit(SHARD_NODES)).cast("int").alias("pieces"))
    cells.write.parquet(f"{path}/cells")
    cells = spark.read.schema("level int, first int, choice int, cell bigint, pieces int").parquet(f"{path}/cells")
    placed = placed.join(cells, _CELL).select(_shard_name(F.pmod(F.xxhash64("code"), "pieces")), "code")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.built(part["code"].to_numpy(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame([{"shard": key[0]} | shard.row()])

    shards = sum(comb(*SCHEMES[schemes[s]]) * max(1, -(-n // SHARD_NODES)) for s, n in sizes.items())
    buckets = max(1, min(shards, 20_000))
    graphs = placed.repartition(buckets, "shard").groupBy("shard").applyInPandas(run, _SHARD)
    name = f"graph_{uuid.uuid4().hex}"
    graphs.write.bucketBy(buckets, "shard").option("path", f"{path}/shards").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    # how the files are cut is kept with them
    spark.createDataFrame([(buckets, [f"{k}-{f}={s}" for (k, f), s in schemes.items()])], "buckets int, schemes array<string>").coalesce(1).write.parquet(f"{path}/settings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """Shards (a bucketed scan), cells and schemes of a written index."""
    settings = spark.read.parquet(f"{path}/settings").first()
    schemes = {tuple(map(int, s.split("=")[0].split("-"))): int(s.split("=")[1]) for s in settings["schemes"]}
    name = f"graph_{uuid.uuid4().hex}"
    fields = _SHARD.replace("shard string", "`shard` string")
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (shard) INTO {settings['buckets']} BUCKETS LOCATION '{path}/shards'")
    shards = spark.table(name)
    shards.schema  # noqa: B018  resolved here, so that the name can go
    spark.sql(f"DROP TABLE {name}")
    return shards, spark.read.schema("level int, first int, choice int, cell bigint, pieces int").parquet(f"{path}/cells"), schemes


def search_index(spark: SparkSession, path: str, queries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Near pairs of ``queries`` (``level``, ``first``, ``code``, ``rank``) and the nodes of the same segment of a written index.

    Result: ``rank``, ``code``, ``level``, ``first``, ``node_code``, each once.
    """
    shards, cells, schemes = read_index(spark, path)
    placed = _celled(queries, schemes)
    asked = placed.groupBy(*_CELL).agg(F.ceil(F.count("*") / F.lit(SHARD_QUERIES)).cast("int").alias("parts")).join(cells, _CELL)
    placed = placed.join(asked, _CELL).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = placed.select(_shard_name(F.col("piece")), "parts", "code", "rank")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        level, first = map(int, key[0].split("-")[:2])
        qi, node = np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(left) and len(right):
            qi, node = Shard.of_row(left.iloc[0], max_bits).search(right["code"].to_numpy(np.int64).view(np.uint64))
        hit = {c: right[c].to_numpy()[qi] for c in ("rank", "code")}
        return pd.DataFrame(hit | {"level": level, "first": first, "node_code": node.view(np.int64)})

    fields = "rank int, code bigint, level int, first int, node_code bigint"
    few = placed.where("parts = 1").select("shard", "code", "rank")
    out = shards.groupBy("shard").cogroup(few.groupBy("shard")).applyInPandas(run, fields)
    # shards with more queries than one task should hold: only their graphs are sent to several tasks
    name = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.concat_ws("-", *_CELL, p))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    hot = asked.where("parts > 1").select(F.explode(name).alias("shard"), "parts")
    graphs = shards.join(hot, "shard").select("*", part).groupBy("shard", "part")
    many = placed.where("parts > 1").select("shard", F.pmod(F.xxhash64("code"), "parts").cast("int").alias("part"), "code", "rank")
    out = out.unionByName(graphs.cogroup(many.groupBy("shard", "part")).applyInPandas(run, fields))
    return out.distinct() if any(SCHEMES[s][1] for s in schemes.values()) else out


# ---- segments
def node_segments(rank: Column, batches: int) -> Column:
    """Segments (level, first batch) that ever serve as history and hold a node of batch ``rank``."""
    out = []
    for k in range(max(1, batches - 1).bit_length()):
        j = F.shiftright(rank, k)
        used = (j % 2 == 0) & (F.shiftleft(j + 1, k) <= batches - 1)
        out.append(F.when(used, F.struct(F.lit(k).alias("level"), F.shiftleft(j, k).alias("first"))))
    return F.array_compact(F.array(*out))


def query_segments(rank: Column, batches: int) -> Column:
    """Segments in force when batch ``rank`` arrives: one per binary digit of its number."""
    out = []
    for k in range(max(1, batches - 1).bit_length()):
        first = F.shiftleft(F.shiftright(rank, k + 1), k + 1)
        out.append(F.when(F.shiftright(rank, k) % 2 == 1, F.struct(F.lit(k).alias("level"), first.alias("first"))))
    return F.array_compact(F.array(*out))


def segment_sizes(rows: list[int]) -> dict[tuple[int, int], int]:
    """Nodes, at most, of every segment that serves as history, from the rows of each batch."""
    used = {(k, t >> (k + 1) << (k + 1)) for t in range(len(rows)) for k in range(t.bit_length()) if t >> k & 1}
    return {(k, first): sum(rows[first : first + (1 << k)]) for k, first in sorted(used)}


# ---- records
def with_rank(df: DataFrame, batch: str) -> tuple[DataFrame, list[int]]:
    """``df`` with ``rank``, the place of its batch among the batches present, and the rows of each."""
    counts = sorted(df.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.count("*").alias("n")).collect())  # a row per batch
    order = df.sparkSession.createDataFrame(pa.table({"b": pa.array([r[0] for r in counts], None if counts else pa.int32()), "rank": pa.array(range(len(counts)), pa.int32())}))
    order = order.select(F.col("b").cast(df.schema[batch].dataType).alias(batch), "rank")
    return df.join(order, batch), [r[1] for r in counts]


def near_classes(coded: DataFrame, counts: list[int], max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprints of each batch with the near ones of the segments before it, by graphs built and written for all segments.

    ``coded``: ``code`` (not null), ``rank``, ``accepted``. Result as of :func:`search_index`.
    """
    spark, batches = coded.sparkSession, len(counts)
    nodes = coded.where("accepted").select("code", F.inline(node_segments(F.col("rank"), batches))).distinct()
    path = scratch_path(spark, "graph")
    build_index(nodes, segment_sizes(counts), path, max_bits)
    queries = coded.select("code", "rank").distinct().select("code", "rank", F.inline(query_segments(F.col("rank"), batches)))
    return search_index(spark, path, queries, max_bits)


def _records(df: DataFrame, id_: str, batch: str) -> tuple[DataFrame, list[int]]:
    """The records in normal spelling, written once, as several joins read them, and the rows of each batch."""
    rows, counts = with_rank(df, batch)
    rows = rows.select(F.col(id_).alias("id"), "rank", "sha", "code", F.coalesce("accepted", F.lit(True)).alias("accepted"))
    rows.write.parquet(path := scratch_path(df.sparkSession, "records"))
    return df.sparkSession.read.schema(rows.schema).parquet(path), counts


def duplicate_pairs(df: DataFrame, id_: str, batch: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs of records of different batches that share the file or nearly the picture.

    ``df`` has ``id_``, ``batch``, ``sha`` (see :func:`file_hash`), ``code``
    (:func:`picture_code`) and boolean ``accepted`` (null counts as accepted). The record of the
    earlier batch must be accepted. Result: ``id_a`` < ``id_b``, each pair once. Records without a
    batch number take no part. The result is as large as the pairs are many;
    :func:`duplicate_links` has one row per record.
    """
    rows, counts = _records(df, id_, batch)
    coded = rows.where("code is not null")
    near = near_classes(coded, counts, max_bits)
    a = coded.where("accepted").select(F.col("code").alias("node_code"), F.col("rank").alias("rank_a"), F.col("id").alias("a"), F.col("sha").alias("sha_a"))
    b = coded.select("code", "rank", F.col("id").alias("b"), F.col("sha").alias("sha_b"))
    pairs = near.join(b, ["code", "rank"]).join(a, "node_code")
    pairs = pairs.where(F.expr("shiftleft(shiftright(rank_a, level), level) = `first`"))
    pairs = pairs.where(~F.col("sha_a").eqNullSafe(F.col("sha_b")) | F.col("sha_a").isNull()).select("a", "b")
    filed = rows.where("sha is not null")
    a = filed.where("accepted").select("sha", F.col("rank").alias("rank_a"), F.col("id").alias("a"))
    b = filed.select("sha", F.col("rank").alias("rank_b"), F.col("id").alias("b"))
    same = a.join(b, "sha").where("rank_a < rank_b").select("a", "b")
    return pairs.unionByName(same).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def duplicate_links(df: DataFrame, id_: str, batch: str, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per record with a batch: ``id``, ``file_links``, ``picture_links``.

    The numbers of accepted records of earlier batches that share its file, and whose picture is
    near. Copies are classes (one file or fingerprint in one batch) and counted, never paired, so a
    hot class is a row.
    """
    rows, counts = _records(df, id_, batch)
    before = Window.partitionBy("sha").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a row per file and batch
    files = rows.where("sha is not null").groupBy("sha", "rank").agg(F.count_if("accepted").alias("n"))
    files = files.select("sha", "rank", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_links"))
    coded = rows.where("code is not null")
    near = near_classes(coded, counts, max_bits)
    held = coded.where("accepted").groupBy(F.col("code").alias("node_code"), F.col("rank").alias("rank_a")).agg(F.count("*").alias("n"))
    near = near.join(held, "node_code").where(F.expr("shiftleft(shiftright(rank_a, level), level) = `first`"))
    near = near.groupBy("code", "rank").agg(F.sum("n").alias("picture_links"))
    out = rows.join(files, ["sha", "rank"], "left").join(near, ["code", "rank"], "left")
    return out.select("id", F.coalesce("file_links", F.lit(0)).alias("file_links"), F.coalesce("picture_links", F.lit(0)).alias("picture_links"))


class GraphHistory:
    """The accepted history of one table as segment folders in a shared folder.

    ``accept`` searches a batch in the stored graphs of the segments in force and adds it as a new
    segment; it reads no records of the history. ``compact``, to be called on a schedule, joins
    neighbouring segments of equal span. Folder ``<level>-<first>`` holds a segment: ``shards`` and
    ``cells`` (the graphs), ``files`` (distinct file hashes) and ``records`` (``id``, ``sha``,
    ``code``, read by ``members`` and ``compact`` only).
    """

    def __init__(self, spark: SparkSession, path: str, max_bits: int = MAX_BITS):
        self.spark, self.path, self.max_bits = spark, path.rstrip("/"), max_bits
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, int]]:
        """(level, first batch) of the segments in force, oldest first."""
        root = self._fs_path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        found = [tuple(map(int, x.split("-"))) for x in names if self._fs.exists(self._fs_path(f"{self.path}/{x}/_DONE"))]
        # a merged segment stands before its parts are deleted: parts inside a larger one are void
        live = [s for s in found if not any(o != s and o[0] > s[0] and o[1] <= s[1] < o[1] + (1 << o[0]) for o in found)]
        return sorted(live, key=lambda s: s[1])

    def _at(self, segment: tuple[int, int], what: str) -> str:
        return f"{self.path}/{segment[0]}-{segment[1]}/{what}"

    def _all(self, what: str) -> DataFrame | None:
        out = None
        for s in self.segments():
            part = self.spark.read.parquet(self._at(s, what))
            out = part if out is None else out.unionByName(part)
        return out

    def _add(self, records: DataFrame, segment: tuple[int, int]) -> None:
        delete_path(self.spark, f"{self.path}/{segment[0]}-{segment[1]}")  # left by a run that died
        records.select("id", "sha", "code").write.parquet(self._at(segment, "records"))
        rows = self.spark.read.schema(records.select("id", "sha", "code").schema).parquet(self._at(segment, "records"))
        rows.where("sha is not null").select("sha").distinct().write.parquet(self._at(segment, "files"))
        codes = rows.where("code is not null").select(F.lit(segment[0]).alias("level"), F.lit(segment[1]).alias("first"), "code").distinct()
        build_index(codes, {segment: max(1, codes.count())}, f"{self.path}/{segment[0]}-{segment[1]}", self.max_bits)
        self._fs.create(self._fs_path(self._at(segment, "_DONE"))).close()

    def accept(self, batch: DataFrame) -> DataFrame:
        """Links of ``batch`` (``id``, ``sha``, ``code``, ``accepted``) to the history's classes; then the batch joins the history.

        Result: ``id`` (of the batch), and either ``old_sha`` or ``old_code``, the class it repeats.
        """
        live = self.segments()
        t = max((f + (1 << k) for k, f in live), default=0)
        batch = batch.select("id", "sha", "code", F.coalesce("accepted", F.lit(True)).alias("accepted"))
        none = F.lit(None)
        links = batch.where("false").select("id", none.cast("string").alias("old_sha"), none.cast("bigint").alias("old_code"))
        codes = batch.where("code is not null").select("code").distinct()
        for k, f in live:
            queries = codes.select("code", F.lit(t).alias("rank"), F.lit(k).alias("level"), F.lit(f).alias("first"))
            near = search_index(self.spark, f"{self.path}/{k}-{f}", queries, self.max_bits).select("code", F.col("node_code").alias("old_code"))
            files = self.spark.read.schema("sha string").parquet(self._at((k, f), "files"))
            links = links.unionByName(batch.join(near, "code").select("id", none.cast("string").alias("old_sha"), "old_code"))
            links = links.unionByName(batch.join(files, "sha").select("id", F.col("sha").alias("old_sha"), none.cast("bigint").alias("old_code")))
        out = f"{self.path}-links/{t:09d}"
        links.distinct().write.mode("overwrite").parquet(out)
        self._add(batch.where("accepted"), (0, t))
        return self.spark.read.schema(links.schema).parquet(out)

    def members(self, links: DataFrame) -> DataFrame:
        """Pairs (``old_id``, ``new_id``) of ``links`` before the next batch, from the history's records."""
        old = self._all("records")
        new = F.col("l.id").alias("new_id")
        l, o = links.alias("l"), old.select(F.col("id").alias("old_id"), "sha", "code").alias("o")  # noqa: E741
        by_code = l.join(o, F.col("l.old_code") == F.col("o.code")).select("old_id", new)
        by_file = l.join(o, F.col("l.old_sha") == F.col("o.sha")).select("old_id", new)
        return by_code.unionByName(by_file).where("old_id <> new_id").distinct()

    def compact(self) -> int:
        """Join neighbouring segments of equal span until none are left; the number of joins."""
        joins = 0
        while True:
            live = self.segments()
            pair = next(((a, b) for a, b in zip(live, live[1:], strict=False) if a[0] == b[0] and a[1] % (2 << a[0]) == 0), None)
            if pair is None:
                return joins
            (k, f), right = pair
            parts = [self.spark.read.parquet(self._at(s, "records")) for s in pair]
            self._add(parts[0].unionByName(parts[1]), (k + 1, f))
            for level, first in ((k, f), right):
                delete_path(self.spark, f"{self.path}/{level}-{first}")
            joins += 1
