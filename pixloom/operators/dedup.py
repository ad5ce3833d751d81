"""Exact duplicates: one row per content, chosen by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by the order columns, with n_copies: the rows that share the key (nulls are one key).

    The row is picked by a min over a struct, so it is combined before the shuffle and a hot key costs one row a task; no sort,
    no window. Order columns are compared ascending, nulls first; where all of them tie, the other columns decide.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    picked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.min(picked).alias("_p"), F.count("*").alias("n_copies")).select(*keys, "_p.row.*", "n_copies")
