"""Structured Streaming flows: file ingest with keyed dedup, attempt breaker, late branch, publish loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.scalars import due
from gleanframe.operators.state import VersionedTable
from gleanframe.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive; zone-less times become instants, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in rows.schema])


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, batch by batch, and stop."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_distinct(stream: DataFrame, keys: list[str], order: list[Column], out: str) -> None:
    """Append the first row of every key, however late it comes; a known key is never entered again.

    The table only grows: a batch adds the rows whose keys the batches before did not bring, and reads
    nothing but their keys. A replayed batch overwrites itself.
    """
    spark = stream.sparkSession

    def each(df: DataFrame, i: int) -> None:
        rest = [c for c in df.columns if c not in keys]
        kept = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__kept")
        fresh = df.dropna(subset=keys).groupBy(*keys).agg(kept).select(*keys, *[F.col(f"__kept.`{c}`").alias(c) for c in rest])
        known = read_batches(spark, out, fresh.schema)
        if known is not None:
            fresh = fresh.join(known.where(F.col("batch") != i).select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={i}")

    run_available(stream, each, f"{out}-checkpoint")


def read_batches(spark: SparkSession, out: str, schema=None) -> DataFrame | None:
    """The rows of all batches below ``out``, with their ``batch``; ``None`` before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    reader = spark.read if schema is None else spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", batch bigint")
    return reader.parquet(out)


def ingest_catalog(stream: DataFrame, key: str, order: list[Column], path: str) -> DataFrame:
    """The first row of every key, kept as :func:`ingest_distinct` does, and a marker once all that was there is in. Returns the table."""
    ingest_distinct(stream, [key], order, path)
    spark = stream.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-complete")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
    return read_batches(spark, path)


def attempt_breaker(stream: DataFrame, key: str, failed: Column, most: int, out: str) -> None:
    """Keys at the moment their failures reach ``most``; the count is keyed state and survives restarts."""
    rows = stream.where(failed).select(F.col(key).cast("string").alias("key"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        if before < most <= now:
            yield pd.DataFrame({"key": [k[0]], "attempts": [now]})

    tripped = rows.groupBy("key").applyInPandasWithState(step, "key string, attempts long", "attempts long", "append", "NoTimeout")
    run_available(tripped, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), f"{out}-checkpoint")


def split_late(stream: DataFrame, late: Column, on_time_out: str, late_out: str, checkpoint: str) -> None:
    """Two sinks from one pass: late rows are set aside, never dropped."""

    def each(df: DataFrame, i: int) -> None:
        marked = df.withColumn("__late", F.coalesce(late, F.lit(False))).persist()
        try:
            marked.where("not __late").drop("__late").write.mode("overwrite").parquet(f"{on_time_out}/batch={i}")
            marked.where("__late").drop("__late").write.mode("overwrite").parquet(f"{late_out}/batch={i}")
        finally:
            marked.unpersist()

    run_available(stream, each, checkpoint)


def publish(queue: DataFrame, done: VersionedTable, key: str, order: list[Column], send: Callable[[DataFrame], DataFrame], most: int = 1, most_a_day: int | None = None) -> DataFrame:
    """Send at most ``most`` rows that were not sent before and record them; sent rows are never sent again.

    ``send`` gets the rows marked as being sent, already recorded, and returns them with their result.
    Rows that an earlier run left as being sent go back into the queue first, so ``send`` must bear a
    row twice. ``most_a_day`` bounds what is sent within 24 hours.
    """
    spark, now = queue.sparkSession, F.lit(datetime.now(UTC)).cast("timestamp")
    known = done.read()
    if known is not None:
        known = done.commit(known.where("state = 'sent'"))  # what a run that died was sending
    todo = queue if known is None else queue.join(known.select(key), key, "left_anti")
    if known is not None and most_a_day is not None:
        lately = known.where(F.col("at") > now - F.expr("INTERVAL 24 HOURS")).count()
        most = max(0, min(most, most_a_day - lately))
    elif most_a_day is not None:
        most = min(most, most_a_day)
    marked = todo.orderBy(*order).limit(most).select(key, F.lit("sending").alias("state"), now.alias("at"))
    path = scratch_path(spark, "sending")
    marked.write.parquet(path)
    marked = spark.read.parquet(path)
    done.commit(marked if known is None else known.unionByName(marked))
    sent = send(marked).select(key, F.lit("sent").alias("state"), now.alias("at"))
    return done.commit(done.read().join(sent.select(key), key, "left_anti").unionByName(sent))


def refresh_due(done: VersionedTable, hours: float) -> bool:
    """Whether the newest row of ``done`` (``at``) is at least so many hours old, or there is none."""
    known = done.read()
    if known is None:
        return True
    return bool(known.agg(due(F.current_timestamp(), F.max("at"), int(hours * 3600)).alias("due")).first()["due"])
