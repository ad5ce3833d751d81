"""Perceptual hashes and color signatures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes kept as ARRAY<BIGINT> words (a plain BIGINT counts as one word)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def color_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two signatures, as far as the shorter one goes."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def difference_hash(values: Column, width: int, bits: int) -> Column:
    """BIGINT of `bits` (63 at most) bits: whether each value is larger than the next in its row of `width`, first bit highest."""
    row = lambda i: i + F.floor(i / (width - 1)).cast("int")
    flags = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: (F.get(values, row(i)) > F.get(values, row(i) + 1)).cast("bigint"))
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda s, x: s * 2 + x)
