"""Queries of the problems solved in this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm.components import connected_groups
from pixloom.llm.entities import match_orphans
from pixloom.llm.leaks import leaked_items
from pixloom.llm.quality import document_kinds
from pixloom.llm.survivors import best_records, undisputed
from pixloom.llm.tokens import encode_corpus, read_rank_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphan sidecars of every content without sidecar, with rule and confidence."""
    return match_orphans(*[table(spark, sf_dir, t) for t in ("copies", "orphans", "sidecar_docs", "exif")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches alone."""
    return p1_matches(spark, sf_dir).select(F.col("hash").alias("sha256"), "orphan_ord")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every group of look-alikes, field by field."""
    return best_records(*[table(spark, sf_dir, t) for t in ("dup_groups", "copies", "sidecar_docs")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors that are best in all five respects, alone."""
    return undisputed(p3_survivors(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked picture with the smallest number it is linked to."""
    return connected_groups(table(spark, sf_dir, "near_pairs")).select(F.col("node").alias("scan_ord"), "group_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), read_rank_file())


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak, and how much of each."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, probabilities and kind of every document."""
    return document_kinds(*[table(spark, sf_dir, t) for t in ("documents", "labels", "common_words")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are not natural prose."""
    return p8_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p3_found": p3_found, "p3_survivors": p3_survivors, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_statistics": p8_statistics}

SQL = {
    "p5_found": """
        WITH RECURSIVE e AS (
          SELECT left_ord AS a, right_ord AS b FROM near_pairs WHERE left_ord IS NOT NULL AND right_ord IS NOT NULL AND left_ord <> right_ord
          UNION SELECT right_ord, left_ord FROM near_pairs WHERE left_ord IS NOT NULL AND right_ord IS NOT NULL AND left_ord <> right_ord
        ), r AS (
          SELECT DISTINCT a AS scan_ord, a AS other FROM e
          UNION SELECT r.scan_ord, e.b FROM r JOIN e ON r.other = e.a
        )
        SELECT scan_ord, min(other) AS group_id FROM r GROUP BY scan_ord
    """,
}
