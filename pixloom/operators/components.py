"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.session import materialise


def _round(links: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the smallest vertex it knows, then its smaller ones: paths halve, stars stay."""
    both = links.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    large = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "links")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return materialise(small.where("u <> v").distinct(), "links")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Null ends and self links are none; repeats count once."""
    now = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = materialise(now.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links")
    before = None
    while True:
        now = _round(now)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
