"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import subjects as S
from gleanframe.sources import table


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.written_blocks(table(spark, sf_dir, "documents"))
    model, names = S.train(spark, table(spark, sf_dir, "subject_samples"), blocks)
    return S.subject_shares(blocks, model, names).where(F.col("share") >= S.SHARE - 1e-9)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least a sixth of a document's sentences treat."""
    return _shares(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and mean share per subject."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"))
    return (
        _shares(spark, sf_dir).join(docs, "doc_id").groupBy("subject")
        .agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.avg("share").alias("mean_share"))
    )


def queries() -> dict:
    return {"p9_found": p9_found, "p9_composition": p9_composition}


def oracle_sql() -> dict[str, str]:
    return {}
