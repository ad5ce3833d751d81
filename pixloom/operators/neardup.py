"""Visually similar pictures: exact pairs within a bit distance and a color distance, and the groups they form."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions.bits import color_distance, hamming
from pixloom.operators.components import components
from pixloom.session import materialise

# Defaults of the distances, for 256-bit hashes and 48-value signatures.
MAX_DISTANCE, MAX_COLOR = 20, 500


def _bands(word_bits: list[int], bands: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of disjoint bands that cover all bits, none across two words."""
    total, out, left = sum(word_bits), [], bands
    for w, bits in enumerate(word_bits):
        here = max(1, round(left * bits / total)) if w < len(word_bits) - 1 else max(1, left)
        total, left = total - bits, left - here
        at = 0
        for k in range(here):
            width = bits // here + (k < bits % here)
            out.append((w, at, width))
            at += width
    return out


def similar_pairs(prints: DataFrame, max_distance: int = MAX_DISTANCE, max_color: int | None = MAX_COLOR, bits: int = 256) -> DataFrame:
    """(left_id, right_id, distance): pairs of prints(id, words ARRAY<BIGINT>, color ARRAY<INT>), left_id < right_id, within both distances.

    Exact: hashes that differ in at most d bits agree wholly in one of d + 1 disjoint bands, so pairs that share a band are all
    candidates. Where bands get narrow (under 8 bits) each of more bands holds less than two values would need: then bands are
    chosen as pairs of m bands with m = d + 2, of which at least two agree, and candidates share both.

    Candidates are looked for among distinct hashes, so flat pictures, which share one, do not meet in a band. The pictures behind a
    pair of hashes, or behind one, are then compared by color: those of equal hash and signature are one, the others meet by cells of
    the sums of their three channels, which differ by no more than the signatures do. Copies come back at the end as a chain (each
    to the first), so the pairs are those of first copies; what hangs together is the same as with all pairs. Rows without id or hash
    are ignored, those without signature are alike only if the hash is equal (or if colors are not asked for).
    """
    rows = prints.where("id is not null and words is not null").select("id", "words", "color" if max_color is not None else F.lit(None).cast("array<int>").alias("color"))
    # copies: the same hash and the same signature; the first stands for all
    same = materialise(rows.groupBy("words", "color").agg(F.min("id").alias("first")), "prints")
    by_hash = materialise(same.groupBy("words").agg(F.min("first").alias("id"), F.count("*").alias("n")), "hashes")
    word_count = max(1, -(-bits // 64))
    sizes = [min(64, bits - 64 * w) for w in range(word_count)]
    pairwise = bits / (max_distance + 1) < 8
    bands = _bands(sizes, max_distance + 2 if pairwise else max_distance + 1)
    value = lambda w, at, width: F.shiftrightunsigned(F.get("words", F.lit(w)), at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    valued = by_hash.select("id", "words", F.array(*[value(*b) for b in bands]).alias("v"))
    m = len(bands)
    one = lambda i: F.struct(i.alias("band"), F.lit(0).alias("other"), F.get("v", i).alias("value"), F.lit(0).cast("bigint").alias("value2"))
    two = lambda i: F.transform(
        F.sequence(i + 1, F.lit(m - 1)), lambda j: F.struct(i.alias("band"), j.alias("other"), F.get("v", i).alias("value"), F.get("v", j).alias("value2"))
    )
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 2)), two)) if pairwise else F.transform(F.sequence(F.lit(0), F.lit(m - 1)), one)
    banded = valued.select("id", "words", F.inline(keys))
    share = ["band", "other", "value", "value2"]
    a = banded.select(*share, F.col("id").alias("lid"), F.col("words").alias("lw"))
    b = banded.select(*share, F.col("id").alias("rid"), F.col("words").alias("rw"))
    near = a.join(b, share).where("lid < rid").withColumn("distance", hamming(F.col("lw"), F.col("rw"))).where(F.col("distance") <= max_distance)
    near = near.select("lw", "rw", "distance").distinct()
    ordered = lambda df: df.select(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"), "distance")
    if max_color is None:
        ends = by_hash.select("words", "id")
        pairs = near.join(ends.toDF("lw", "l"), "lw").join(ends.toDF("rw", "r"), "rw")
    else:
        cell = lambda k: F.floor(F.aggregate(F.filter("color", lambda _, i: i % 3 == k), F.lit(0).cast("bigint"), lambda t, x: t + x) / F.lit(max_color + 1))
        celled = same.where("color is not null").select("words", F.col("first").alias("id"), "color", *[cell(k).alias(f"c{k}") for k in range(3)])
        around = F.array(*[F.struct(*[(F.col(f"c{k}") + d[k]).alias(f"c{k}") for k in range(3)]) for d in product((-1, 0, 1), repeat=3)])
        cells = ["c0", "c1", "c2"]
        left = celled.select(F.col("words").alias("lw"), F.col("id").alias("l"), F.col("color").alias("lc"), F.inline(around))
        right = celled.select(F.col("words").alias("rw"), F.col("id").alias("r"), F.col("color").alias("rc"), *cells)
        alike = by_hash.where("n > 1").select(F.col("words").alias("lw"), F.col("words").alias("rw"), F.lit(0).alias("distance"))
        met = near.unionByName(alike).join(left, "lw").join(right, ["rw", *cells])
        pairs = met.where(((F.col("distance") > 0) | (F.col("l") < F.col("r"))) & (color_distance(F.col("lc"), F.col("rc")) <= max_color))
    copies = rows.join(same, (rows.words == same.words) & rows.color.eqNullSafe(same.color)).where("id <> first").select(F.col("first").alias("left_id"), F.col("id").alias("right_id"), F.lit(0).alias("distance"))
    return ordered(pairs).unionByName(copies)


def similar_groups(prints: DataFrame, max_distance: int = MAX_DISTANCE, max_color: int | None = MAX_COLOR, bits: int = 256) -> DataFrame:
    """(id, group_id): pictures linked by similar pairs, directly or through others, with the smallest id as group."""
    return components(similar_pairs(prints, max_distance, max_color, bits), "left_id", "right_id").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(size, n_groups, extras): how many groups there are of each size, and the pictures beyond the first of each."""
    per = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    return per.groupBy("size").agg(F.count("*").alias("n_groups"), F.sum(F.col("size") - 1).alias("extras"))
