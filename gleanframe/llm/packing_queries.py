"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.packing import pack
from gleanframe.llm.tokens import VOCABULARY, token_count
from gleanframe.session import scratch_path
from gleanframe.sources import table


def sized_documents(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``item`` and ``size`` in tokens of every document, written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "sizes")
    docs.select(F.col("doc_id").alias("item"), token_count(F.col("text"), vocabulary).alias("size")).write.parquet(path)
    return spark.read.parquet(path)


def p7_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of every capacity."""
    placed, _ = pack(sized_documents(spark, sf_dir), table(spark, sf_dir, "containers"))
    return placed.select(
        "container", "bin", F.col("item").alias("doc_id"), "piece", F.col("start").alias("from_token"), F.col("size").alias("tokens")
    )


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers used, the least number by volume and as the program proves, the fullest container and the fill."""
    placed, plans = pack(sized_documents(spark, sf_dir), table(spark, sf_dir, "containers"))
    kinds = spark.createDataFrame([(k, p.capacity, p.bound) for k, p in plans.items()], "container string, capacity int, proven_bins bigint")
    bins = placed.groupBy("container", "bin").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"))
    sums = bins.groupBy("container").agg(
        F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")
    )
    fill = F.col("tokens") / (F.col("bins") * F.col("capacity"))
    return sums.join(kinds, "container").select("container", "capacity", "bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), "proven_bins", "pieces", "tokens", "fullest", fill.alias("fill"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity what must hold: all documents placed, none overfull, none split that fits, no token lost or twice."""
    sizes = sized_documents(spark, sf_dir)
    placed, _ = pack(sizes, table(spark, sf_dir, "containers"))
    kinds = table(spark, sf_dir, "containers").select("container", F.col("capacity_tokens").alias("capacity"))
    bins = placed.groupBy("container", "bin").agg(F.sum("size").alias("tokens")).join(kinds, "container")
    bins = bins.groupBy("container").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    items = placed.groupBy("container", "item").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("size")).alias("ends"))
    items = items.join(sizes, "item", "full_outer").join(kinds, "container", "left")
    items = items.groupBy("container").agg(
        F.count("item").alias("documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("split_that_fit"),
        F.count_if(~F.col("tokens").eqNullSafe(F.col("size")) | ~F.col("ends").eqNullSafe(F.col("size"))).alias("wrong_tokens"),
    )
    return items.join(bins, "container", "left")


def queries() -> dict:
    return {"p7_assign": p7_assign, "p7_fill": p7_fill, "p7_check": p7_check}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_check": "SELECT container, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS split_that_fit, 0::BIGINT AS wrong_tokens, 0::BIGINT AS overfull FROM containers"
    }
