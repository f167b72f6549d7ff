"""Queries of problem 2."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import graph_index as G
from gleanframe.sources import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "images").select(
        "id",
        "batch_no",
        G.file_hash(F.col("sha256")).alias("sha"),
        G.picture_code(F.col("phash")).alias("code"),
        (F.col("status") != "rejected").alias("accepted"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records with the same file or nearly the same picture, new batch against history."""
    return G.duplicate_pairs(_records(spark, sf_dir), "id", "batch_no")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record the numbers of accepted earlier records with its file and with nearly its picture."""
    return G.duplicate_links(_records(spark, sf_dir), "id", "batch_no")


_SQL_RECORDS = r"""
WITH bare AS (
  SELECT id, batch_no, coalesce(status, '') <> 'rejected' AS accepted,
    regexp_replace(lower(trim(sha256, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288))), '^(sha-?256\s*[:=]?\s*|0x)', '') AS s,
    regexp_replace(lower(trim(phash, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288))), '^(p?hash\s*[:=]\s*|0x)', '') AS p
  FROM images WHERE batch_no IS NOT NULL
), r AS (
  SELECT id, batch_no, accepted, CASE WHEN regexp_matches(s, '^[0-9a-f]{64}$') THEN s END AS sha,
    CASE WHEN regexp_matches(p, '^[0-9a-f]{16}$') THEN CAST('0x' || p AS UBIGINT) END AS code FROM bare
)
"""
_SQL_NEAR = "a.batch_no < b.batch_no AND a.accepted AND bit_count(xor(a.code, b.code)) <= 6"


def queries() -> dict:
    return {"p2_found": p2_found, "p2_links": p2_links}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _SQL_RECORDS
        + f"""SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM r a JOIN r b ON {_SQL_NEAR}
UNION SELECT least(a.id, b.id), greatest(a.id, b.id) FROM r a JOIN r b ON a.sha = b.sha AND a.batch_no < b.batch_no AND a.accepted""",
        "p2_links": _SQL_RECORDS
        + f""", f AS (SELECT b.id, count(*) AS n FROM r a JOIN r b ON a.sha = b.sha AND a.batch_no < b.batch_no AND a.accepted GROUP BY b.id),
p AS (SELECT b.id, count(*) AS n FROM r a JOIN r b ON {_SQL_NEAR} GROUP BY b.id)
SELECT r.id, coalesce(f.n, 0) AS file_links, coalesce(p.n, 0) AS picture_links FROM r LEFT JOIN f USING (id) LEFT JOIN p USING (id)""",
    }
