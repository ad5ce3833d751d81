"""Best representative of each duplicate group: iterative truth discovery over what five respects say of the members.

Each respect (has a dated document, loose over archived, place, the reviewer's mark, size) is a source. It claims that the record
to keep, and the group's value of every field, are those of the members it ranks best. A value's support is the sum of the
reliabilities of the sources that claim it, and a source's reliability is the share of groups and fields where it claims the
value that wins; the two are computed in turn until the reliabilities stand still. Winners depend on the reliabilities only through
finitely many comparisons, so the sequence comes back to reliabilities it had: mostly to the last ones (convergence), else it goes
round a circle, of which the member with the largest support of all winners is taken.

Groups enter that loop only as patterns: for a group and field, the set of claims (five bits each) that its values have. Patterns
are counted before the loop, so a round reads a table whose size depends on the number of patterns and returns five numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.functions.records import ref_id
from pixloom.operators.timestamps import sidecar_values, stated_instants
from pixloom.session import materialise

RESPECTS = ("dated", "loose", "place", "kept", "size")
ALL = (1 << len(RESPECTS)) - 1
FIELDS = ("name", "path", "dims", "size")


def place_rank(place: Column) -> Column:
    """2 outside trash and archive, 1 in an archive, 0 in trash, by the components of a path in any letter case; -1 if unknown."""
    parts = F.split(F.lower(place), r"[/\\]")
    return F.when(place.isNull(), -1).when(F.array_contains(parts, "trash"), 0).when(F.array_contains(parts, "archive"), 1).otherwise(2)


def _members(dup_groups: DataFrame, copies: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per member, of its latest review, with the five respects as numbers (larger is better)."""
    row = F.struct("reviewed_at", F.coalesce("suggest_keep", F.lit(False)).alias("keep"), "size_bytes", "name", "path", "w", "h")
    latest = (
        dup_groups.where("group_id is not null and scan_ord is not null")
        .groupBy("group_id", "scan_ord")
        .agg(F.max(row).alias("r"))
        .select("group_id", "scan_ord", "r.*")
    )
    latest = materialise(latest, "members")
    wanted = latest.select("scan_ord").distinct()
    known = copies.select("scan_ord", "src", F.coalesce("path", "entry").alias("at"), ref_id("sidecar").alias("ref")).join(wanted, "scan_ord", "left_semi")
    known = materialise(known.groupBy("scan_ord").agg(F.max(F.struct("src", "at", "ref")).alias("c")).select("scan_ord", "c.*"), "known")
    refs = known.where("ref is not null").select("ref").distinct()
    mine = docs.withColumn("ref_id", ref_id("ref")).join(refs.withColumnRenamed("ref", "ref_id"), "ref_id", "left_semi")
    dated = materialise(stated_instants(sidecar_values(mine)).where("field = 'photoTakenTime'").select("rec_id", "epoch_us"), "dated").where("epoch_us is not null")
    dated = mine.select("ref_id", F.col("sidecar_id").alias("rec_id")).join(dated.select("rec_id").distinct(), "rec_id", "left_semi").select(F.col("ref_id").alias("ref")).distinct()
    facts = known.join(dated.withColumn("dated", F.lit(1)), "ref", "left").select(
        "scan_ord", F.coalesce("dated", F.lit(0)).alias("dated"), F.when(F.lower("src") == "dir", 1).otherwise(0).alias("loose"), place_rank(F.col("at")).alias("place"), "at"
    )
    return latest.join(facts, "scan_ord", "left").select(
        "group_id",
        "scan_ord",
        *[F.coalesce(c, F.lit(least)).cast("bigint").alias(c) for c, least in (("dated", 0), ("loose", 0), ("place", -1))],
        F.col("keep").cast("bigint").alias("kept"),
        F.coalesce("size_bytes", F.lit(-1)).alias("size"),
        "name",
        F.coalesce("at", "path").alias("path"),
        F.when((F.col("w") > 0) & (F.col("h") > 0), F.concat_ws("x", "w", "h")).alias("dims"),
    )


def _claims(members: DataFrame) -> DataFrame:
    """Adds mask: bit i is set where respect i ranks the member best of its group (or equal to the best)."""
    best = members.groupBy("group_id").agg(*[F.max(r).alias(f"best_{r}") for r in RESPECTS])
    bits = [F.when(F.col(r) == F.col(f"best_{r}"), 1 << i).otherwise(0) for i, r in enumerate(RESPECTS)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return members.join(best, "group_id").withColumn("mask", mask).drop(*[f"best_{r}" for r in RESPECTS])


def _support(mask: Column, weights: list[float] | tuple[float, ...]) -> Column:
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, w).otherwise(0.0)
    return F.round(total, 9)


def reliabilities(patterns: DataFrame) -> list[float]:
    """The reliability of each respect, from (claims ARRAY<INT>, n): how many groups and fields have values with these claims."""
    weights = tuple([1.0 / len(RESPECTS)] * len(RESPECTS))
    met: dict[tuple[float, ...], float] = {}
    order: list[tuple[float, ...]] = []
    while weights not in met:
        best = F.array_max(F.transform("claims", lambda m: F.struct(_support(m, weights).alias("s"), m.alias("m"))))  # noqa: B023
        sums = [F.sum(F.when(best["m"].bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)) for i in range(len(RESPECTS))]
        row = patterns.agg(F.sum("n"), F.sum(best["s"] * F.col("n")), *sums).first()
        if not row[0]:
            return list(weights)
        met[weights] = row[1]
        order.append(weights)
        shares = [(s + 1) / (row[0] + 2) for s in row[2:]]
        weights = tuple(round(s / sum(shares), 12) for s in shares)
    return list(max(order[order.index(weights) :], key=lambda w: (met[w], w)))


def best_records(dup_groups: DataFrame, copies: DataFrame, sidecar_docs: DataFrame) -> DataFrame:
    """(group_id, scan_ord, support, claims, equals, name, path, dims, size): the surviving record of each group.

    scan_ord is the member with the highest support (of equal ones the smallest), support the share of reliability behind it,
    claims the respects that rank it best (bits, ALL if every one does), equals how many members have those same claims. name,
    path, dims and size are each the highest-supported value among the members that have one (dims need both sides positive).

    Of each member only the row reviewed last counts (a null time is before all others; of equal times the marked, then the
    larger one). Members that copies does not know are loose nowhere and in no place; a null mark is no mark; a null size is
    below all others. Rows without group or member are ignored. An empty table gives no rows.
    """
    claimed = materialise(_claims(_members(dup_groups, copies, sidecar_docs)), "claims")
    values = F.array(F.struct(F.lit("keep").alias("field"), F.col("scan_ord").cast("string").alias("value")), *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS])
    each = claimed.select("group_id", "scan_ord", "mask", F.inline(values)).where("value is not null and not (field = 'size' and value = '-1')")
    by_value = each.groupBy("group_id", "field", "value").agg(F.bit_or("mask").alias("mask"), F.min("scan_ord").alias("first"))
    by_value = materialise(by_value, "values")
    # at most 31 distinct claims a group, however many members it has
    patterns = by_value.groupBy("group_id", "field").agg(F.array_sort(F.collect_set("mask")).alias("claims")).groupBy("claims").agg(F.count("*").alias("n"))
    weights = reliabilities(materialise(patterns, "patterns"))
    rank = F.struct(_support(F.col("mask"), weights).alias("support"), (-F.col("first")).alias("order"), "value", "mask")
    won = by_value.groupBy("group_id", "field").agg(F.max(rank).alias("w"))
    wide = won.groupBy("group_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("w.value"))).alias(f) for f in ("keep", *FIELDS)],
        F.max(F.when(F.col("field") == "keep", F.col("w.support"))).alias("support"),
        F.max(F.when(F.col("field") == "keep", F.col("w.mask"))).alias("claims"),
    )
    equals = claimed.groupBy("group_id", F.col("mask").alias("claims")).agg(F.count("*").alias("equals"))
    return wide.join(equals, ["group_id", "claims"]).select(
        "group_id", F.col("keep").cast("bigint").alias("scan_ord"), "support", "claims", "equals", "name", "path", "dims", F.col("size").cast("bigint").alias("size")
    )


def undisputed(records: DataFrame) -> DataFrame:
    """(group_id, scan_ord): survivors that every respect ranks best and that no other member equals in all of them.

    A member that all sources claim has the highest support under any reliabilities, so nothing is missed by looking at survivors.
    """
    return records.where((F.col("claims") == ALL) & (F.col("equals") == 1)).select("group_id", "scan_ord")
