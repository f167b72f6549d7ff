"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.llm.mixing import BLOCK, mix, reached, written
from gleanframe.llm.tokens import VOCABULARY, token_count
from gleanframe.sources import table


def _docs(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return written(spark, docs.select("source", "doc_id", token_count(F.col("text"), vocabulary).alias("tokens")), "mix")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: which tokens of which document fill which slot."""
    return mix(_docs(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and really reached per source."""
    docs, targets = _docs(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return reached(mix(docs, targets), docs, targets)


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target what must hold: no block used above the cap, no token of a block twice, every share as near the target as a draw of so many blocks comes (one point and five standard deviations)."""
    docs, targets = _docs(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = written(spark, mix(docs, targets), "mixed")
    uses = mixed.groupBy("source", "block", "doc_id", "from_token").agg(F.count("*").alias("uses"), F.countDistinct("epoch").alias("epochs"))
    uses = uses.groupBy("source").agg(F.max("uses").alias("most"), F.count_if(F.col("uses") != F.col("epochs")).alias("twice"))
    shares = reached(mixed, docs, targets).where("documents > 0").withColumns({"whole": F.sum("target_share").over(Window.partitionBy()), "drawn": F.sum("tokens_used").over(Window.partitionBy()) / BLOCK})  # a row per target
    out = shares.join(uses, "source", "left").withColumn("wanted", F.col("target_share") / F.col("whole"))
    near = 0.01 + 5 * F.sqrt(F.col("wanted") * (1 - F.col("wanted")) / F.greatest(F.col("drawn"), F.lit(1)))
    return out.select(
        "source", "documents", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("above_cap"),
        F.coalesce("twice", F.lit(0)).alias("blocks_twice_in_an_epoch"),
        (F.abs(F.col("reached_share") - F.col("wanted")) > near).alias("off_target"),
    )


def queries() -> dict:
    return {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_check": p8_check}


def oracle_sql() -> dict[str, str]:
    return {
        "p8_check": """SELECT lower(trim(t.source)) AS source, count(*) AS documents, false AS above_cap, 0::BIGINT AS blocks_twice_in_an_epoch, false AS off_target
FROM mix_targets t JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source)) GROUP BY ALL"""
    }
