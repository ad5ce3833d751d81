"""Review of similar pictures: which to keep, and applying a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def registry(groups: DataFrame) -> DataFrame:
    """groups(group_id, path, size) with rank_no (0 for the largest; ties by path) and suggest_keep (rank 0)."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc_nulls_last("size"), "path")) - 1
    return groups.withColumn("rank_no", rank).withColumn("suggest_keep", F.col("rank_no") == 0)


def present_groups(groups: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of groups(group_id, path) whose file listing(path) still has, in groups of which two or more are left."""
    left = groups.join(listing.select("path").distinct(), "path", "left_semi")
    enough = left.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return left.join(enough, "group_id", "left_semi")


def selected_moves(registry: DataFrame, selection: DataFrame, removed_dir: str) -> DataFrame:
    """(id, path, target) for the selected ids that the registry knows; unknown ids are ignored."""
    known = registry.join(selection.select("id").distinct(), "id", "left_semi")
    return known.select("id", "path", F.concat(F.lit(removed_dir.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("target"))
