"""Mixing sources to target weights (problem 8).

Every source's texts, in a pseudorandom order of documents, form one stream of tokens that is cut
into blocks of fixed length (the last block of a source may be short). The mix is a sequence of
slots, grouped in output shards. Each shard draws how many of its slots go to which source
from a multinomial distribution with the target shares, seeded by the shard's number. Running sums
over the shards, in two steps (over ranges of shards and inside them), number the slots of a source; slot k reads block ``perm_e(k mod blocks)`` in epoch
``e = k div blocks``, where ``perm_e`` is a pseudorandom permutation of the block indexes (a
Feistel network, walked until it lands inside). Slots and blocks are joined by that index. No
order is ever held in memory, and a lost task redraws the same numbers.

Shares are set over the sources that have tokens at all (a target without documents is reported
with share 0 and the others are scaled up). The number of slots is the largest for which the
scarcest source stays ``SIGMAS`` standard deviations below its capped supply; should a source be drawn
more often than its cap allows (a chance below 1e-9), all counts are drawn anew with the next seed, so
no slot is left out and no block repeated too often. Documents of sources without a target
are not part of the mix. Null or empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.session import scratch_path

BLOCK = 256
SLOTS_PER_SHARD = 512
SIGMAS = 6.0
#: Documents of a source's stream, and shards of a range, that one task numbers.
NUMBERED, RANGE = 500_000, 4_096


def normal_source(c):
    """A source name without regard to case and outer blanks."""
    from gleanframe.functions.timestamps import trim_space

    return F.lower(trim_space(c))


# ---- permutation
def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 .. size-1 per row, chosen by ``key``; vectorised cycle walk."""
    index, size, key = (np.asarray(x, np.uint64) for x in (index, size, key))
    bits = np.ones(len(size), np.uint64)
    for _ in range(32):  # half the bits of the smallest even power of two that holds ``size``
        bits += (np.uint64(1) << (bits * np.uint64(2))) < size
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (_scramble(right + (k ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64))) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---- blocks
def block_spans(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Which tokens of which document lie in which block of its source.

    ``docs``: ``source``, ``doc_id``, ``tokens`` (a written table, it is read twice). Result:
    ``source``, ``block``, ``doc_id``, ``from_token``, ``to_token``, ``at`` (place in the block).
    Positions are running sums in two steps, over buckets and inside them; there are as many
    buckets as keep each at about ``NUMBERED`` documents, so the largest source is spread over all tasks.
    """
    bits = max(6, (docs.count() // NUMBERED).bit_length())
    rows = docs.where("tokens > 0").select("source", "doc_id", "tokens").withColumn("__place", F.xxhash64("doc_id"))
    rows = rows.withColumn("__bucket", F.shiftrightunsigned(F.col("__place"), 64 - bits).cast("bigint"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "__bucket").agg(F.sum("tokens").alias("__n"))
    starts = starts.select("source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "__bucket"])
    rows = rows.withColumn("__start", F.col("__base") + F.col("__in"))
    first, last = F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("tokens") - 1) / block)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("__start"))
    end = F.least(F.col("tokens"), (F.col("block") + 1) * block - F.col("__start"))
    return rows.select(
        "source", "block", "doc_id", begin.alias("from_token"), end.alias("to_token"), (F.col("__start") + begin - F.col("block") * block).alias("at")
    )


# ---- slots
def slot_count(blocks: dict[str, int], share: dict[str, float], repeats: dict[str, int]) -> int:
    """Slots that every source's capped supply can serve."""
    n = None
    for s, p in share.items():
        cap = blocks[s] * repeats[s]
        sd = SIGMAS * np.sqrt(1 - p)
        root = (-sd + np.sqrt(sd * sd + 4 * cap)) / 2  # x + sd * sqrt(x) = cap
        fits = int(root * root / p) if p < 1 else cap
        n = fits if n is None else min(n, fits)
    return n or 0


def slots(spark: SparkSession, blocks: dict[str, int], share: dict[str, float], repeats: dict[str, int], seed: int = 0) -> DataFrame:
    """All slots: ``shard``, ``slot``, ``source``, ``epoch``, ``block``."""
    names = sorted(share)
    total = slot_count({s: blocks[s] for s in names}, share, repeats)
    shards = -(-total // SLOTS_PER_SHARD)
    p = np.array([share[s] for s in names], float)
    p = p / p.sum() if len(p) else p

    def drawn(seed: int) -> DataFrame:
        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for shard in b["id"]:
                    size = min(SLOTS_PER_SHARD, total - shard * SLOTS_PER_SHARD)
                    counts = np.random.default_rng([seed, shard]).multinomial(size, p)
                    out.append(pd.DataFrame({"shard": shard, "source": names, "n": counts, "place": np.cumsum(counts) - counts}))
                if out:
                    yield pd.concat(out, ignore_index=True)

        return spark.range(shards).mapInPandas(draw, "shard bigint, source string, n bigint, place bigint")

    for _ in range(100):
        counts = drawn(seed)
        sums = counts.groupBy("source").agg(F.sum("n").alias("n")).collect()  # a row per source
        if all(r["n"] <= blocks[r["source"]] * repeats[r["source"]] for r in sums):
            break
        seed += 1
    else:
        raise ValueError("no draw stays within the caps")
    # a row per shard and source; ranges of shards first, then the shards of a range
    counts = counts.withColumn("range", F.floor(F.col("shard") / RANGE))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("source", "range").agg(F.sum("n").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    before = Window.partitionBy("source", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0").join(base, ["source", "range"])
    counts = counts.withColumn("first", F.col("first") + F.col("base"))
    rows = counts.select("shard", "source", "place", F.col("first").alias("f"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    rows = rows.select("shard", "source", (F.col("place") + F.col("i")).alias("ordered"), (F.col("f") + F.col("i")).alias("k"))
    source_key = {s: i for i, s in enumerate(names)}

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["source"].map(blocks).to_numpy(np.uint64)
            k = b["k"].to_numpy(np.uint64)
            epoch = k // size
            key = _scramble(epoch * np.uint64(64) + b["source"].map(source_key).to_numpy(np.uint64) + np.uint64(1 << 40) * np.uint64(seed + 1))
            shard = b["shard"].to_numpy(np.uint64)
            here = np.minimum(SLOTS_PER_SHARD, total - b["shard"].to_numpy(np.int64) * SLOTS_PER_SHARD)
            # slots of a source are scattered over the shard
            slot = permute(b["ordered"].to_numpy(), here, _scramble(shard + np.uint64(1 << 50)))
            yield pd.DataFrame({"shard": b["shard"], "slot": slot, "source": b["source"], "epoch": epoch.astype(np.int64), "block": permute(k % size, size, key)})

    return rows.mapInPandas(locate, "shard bigint, slot bigint, source string, epoch bigint, block bigint")


def mix(docs: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as spans of documents.

    ``docs``: ``source``, ``doc_id``, ``tokens``; ``targets``: ``source``, ``target_share``,
    ``max_repeats`` (a row per source, a handful of settings). Result: ``shard``, ``slot``,
    ``at``, ``source``, ``epoch``, ``block``, ``doc_id``, ``from_token``, ``to_token``.
    """
    spark = docs.sparkSession
    wanted = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    wanted = wanted.where("target_share > 0 and max_repeats > 0 and source is not null")
    named = docs.select(normal_source(F.col("source")).alias("source"), "doc_id", "tokens").join(wanted.select("source"), "source", "left_semi")
    setting = {r["source"]: r for r in wanted.collect()}
    have = {r["source"]: int(r["t"]) for r in named.groupBy("source").agg(F.sum("tokens").alias("t")).collect() if r["t"]}
    blocks = {s: -(-t // block) for s, t in have.items()}
    whole = sum(setting[s]["target_share"] for s in have)
    share = {s: setting[s]["target_share"] / whole for s in have}
    repeats = {s: int(setting[s]["max_repeats"]) for s in have}
    order = slots(spark, blocks, share, repeats, seed)
    spans = block_spans(named, block)
    # both sides grow with the data; the slots' size isn't known to the planner, so no broadcast
    return order.hint("merge").join(spans.hint("merge"), ["source", "block"]).select("shard", "slot", "at", "source", "epoch", "block", "doc_id", "from_token", "to_token")


def reached(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens and documents in supply, tokens in the mix, shares wanted and reached."""
    wanted = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    supply = docs.groupBy(normal_source(F.col("source")).alias("source")).agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens_in_supply")
    )
    used = mixed.groupBy("source").agg(
        F.sum(F.col("to_token") - F.col("from_token")).alias("tokens_used"), (F.max("epoch") + 1).alias("most_repeats")
    )
    all_used = Window.partitionBy()  # a row per target
    out = wanted.join(supply, "source", "left").join(used, "source", "left").na.fill(0)
    total = F.sum("tokens_used").over(all_used)
    return out.withColumn("reached_share", F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0))


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)
