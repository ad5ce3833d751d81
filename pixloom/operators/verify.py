"""Checks that nothing was lost, and their verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions import filetypes as T
from pixloom.functions import paths as P

SAMPLE = 50
SHOWN = 30


def _check(df: DataFrame, section: str, metric: str, value, status) -> DataFrame:  # noqa: ANN001 - columns
    return df.select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), value.cast("bigint").alias("value"), status.alias("status"))


def count_checks(inventory: DataFrame, done: DataFrame, files: DataFrame) -> DataFrame:
    """(section, metric, value, status) of inventory(sha256), done(sha256) and files(rel_path) found in the library.

    status is ok, fail or info: fails if the number of done contents differs from that of media files (value: expected - found);
    contents that are done but no longer in the inventory only inform.
    """
    inv = inventory.select(F.lower("sha256").alias("h")).where("h is not null").distinct()
    fin = done.select(F.lower("sha256").alias("h")).where("h is not null").distinct()
    media = files.where(T.is_media(P.base_name(F.col("rel_path"))))
    n_done, n_files = fin.agg(F.count("*").alias("d")), media.agg(F.count("*").alias("f"))
    both = n_done.select("d", F.lit(0).alias("f")).unionByName(n_files.select(F.lit(0).alias("d"), "f")).agg(F.sum("d").alias("d"), F.sum("f").alias("f"))
    stale = fin.join(inv, "h", "left_anti").agg(F.count("*").alias("s"))
    info = F.lit("info")
    return reduce(
        DataFrame.unionByName,
        [
            _check(inv.agg(F.count("*").alias("n")), "counts", "unique in inventory", F.col("n"), info),
            _check(n_done, "counts", "done", F.col("d"), info),
            _check(n_files, "counts", "media files", F.col("f"), info),
            _check(both, "counts", "missing", F.col("d") - F.col("f"), F.when(F.col("d") == F.col("f"), "ok").otherwise("fail")),
            _check(stale, "counts", "stale", F.col("s"), F.when(F.col("s") == 0, "ok").otherwise("info")),
        ],
    )


def undated_check(files: DataFrame) -> DataFrame:
    """How many media files lie below a folder `unknown` of the library; that only informs."""
    unknown = F.array_contains(F.split("rel_path", "/"), "unknown") & T.is_media(P.base_name(F.col("rel_path")))
    n = files.agg(F.count(F.when(unknown, 1)).alias("n"))
    return _check(n, "unknown", "undated", F.col("n"), F.when(F.col("n") == 0, "ok").otherwise("info"))


def errors_check(errors: DataFrame) -> DataFrame:
    """How many files were mirrored to the errors folder; that only informs."""
    n = errors.agg(F.count("*").alias("n"))
    return _check(n, "errors", "skipped", F.col("n"), F.when(F.col("n") == 0, "ok").otherwise("info"))


def sample_dated(files: DataFrame, probed: DataFrame, seed: int = 0, size: int = SAMPLE) -> DataFrame:
    """(rel_path, dated) of a sample of dated media files, drawn by a seeded hash (MD5) of the path; probed(rel_path, text)."""
    eligible = files.where(T.is_media(P.base_name(F.col("rel_path"))) & ~F.array_contains(F.split("rel_path", "/"), "unknown")).select("rel_path").distinct()
    drawn = eligible.orderBy(F.md5(F.concat("rel_path", F.lit(f"#{seed}"))), "rel_path").limit(size)
    return drawn.join(probed.where("text is not null and text <> ''").select("rel_path").distinct().withColumn("_d", F.lit(True)), "rel_path", "left").select("rel_path", F.col("_d").isNotNull().alias("dated"))


def sample_check(sampled: DataFrame) -> DataFrame:
    n = sampled.agg(F.count(F.when(~F.col("dated"), 1)).alias("n"))
    return _check(n, "metadata", "sampled without date", F.col("n"), F.when(F.col("n") == 0, "ok").otherwise("fail"))


def verdict(checks: DataFrame) -> DataFrame:
    """(safe, n_failed): safe if no check failed; no checks at all are not safe."""
    failed = F.count(F.when(F.col("status") == "fail", 1))
    return checks.agg(((failed == 0) & (F.count("*") > 0)).alias("safe"), failed.alias("n_failed"))


def first_shown(files: DataFrame, order: str = "rel_path", shown: int = SHOWN) -> DataFrame:
    """The first rows of a report (30), in order."""
    return files.orderBy(order).limit(shown)


def error_counts(errors: DataFrame) -> DataFrame:
    """(category, n) of errors(category, ident, detail), most frequent first."""
    return errors.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
