"""The queries of the general data-processing problems (p2, p4) and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixloom.operators.capture import pending_contents
from pixloom.operators.timestamps import named_instants, normalise_times
from pixloom.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable time with where its zone came from, estimated zones included."""
    return normalise_times(table(spark, sf_dir, "sidecar_docs"), table(spark, sf_dir, "exif"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times whose instant is stated."""
    return named_instants(p2_times(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents a run has to take up: one capture run from an empty state."""
    return pending_contents(table(spark, sf_dir, "copies"), table(spark, sf_dir, "extracted"), work_dir(spark, "capture"))


QUERIES = {"p2_found": p2_found, "p2_times": p2_times, "p4_found": p4_found}

P4_SQL = """
WITH c AS (
  SELECT coalesce(path, zip || '::' || entry) AS place, lower(sha256) AS hash, scanned_at, scan_ord
  FROM copies WHERE sha256 IS NOT NULL AND coalesce(path, zip || '::' || entry) IS NOT NULL
), latest AS (
  SELECT hash, row_number() OVER (PARTITION BY place ORDER BY scanned_at DESC NULLS LAST, scan_ord DESC) AS r FROM c
), fin AS (
  SELECT DISTINCT regexp_extract(lower(hash), '([0-9a-f]{64})', 1) AS hash
  FROM extracted WHERE hash IS NOT NULL AND outcome IN ('placed', 'archived', 'trashed', 'motion')
)
SELECT DISTINCT hash FROM latest WHERE r = 1 AND hash NOT IN (SELECT hash FROM fin)
"""

SQL = {"p4_found": P4_SQL}
