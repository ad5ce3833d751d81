"""One copy per content: which copy stands for it, its bucket and its albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.functions import paths as P
from pixloom.functions.records import record_id, ref_id
from pixloom.operators.matching import choose_sidecar, match_anywhere
from pixloom.session import materialise


def content_bucket(bucket: Column) -> Column:
    """Aggregate: null if any copy is in no bucket, else archive if any is there, else trash."""
    return F.when(F.max(bucket.isNull()), None).when(F.max(bucket == "archive"), "archive").otherwise("trash")


def albums_of(place: Column) -> Column:
    """Aggregate: the sorted distinct albums of the copies."""
    return F.array_sort(F.collect_set(P.album_of(place)))


def select_winners(copies: DataFrame, orphans: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per sha256: scan_ord, name, place, sidecar (an id), recovered, bucket, albums, n_copies.

    The first copy with a sidecar in its own folder stands for the content; else the first copy for whose name an orphan is found
    (recovered); else the first copy, without sidecar. Copies are taken in the order of scan_ord. Rows without sha256 are ignored.

    Everything is picked by aggregates over small structs that are combined before the shuffle; albums are collected as sets of
    folder names.
    """
    rows = copies.where("sha256 is not null").select(F.lower("sha256").alias("sha256"), "scan_ord", "name", record_id().alias("place"), P.place().alias("inside"), "bucket", ref_id("sidecar").alias("own"))
    first = F.struct("scan_ord", "name", "place", "own")
    # Written where they are read more than once: contents, the copies of contents without sidecar, and what their names find.
    per = rows.groupBy("sha256").agg(
        F.min(F.when(F.col("own").isNotNull(), first)).alias("with"), F.min(first).alias("any"), content_bucket(F.col("bucket")).alias("bucket"), albums_of(F.col("inside")).alias("albums"), F.count("*").alias("n_copies")
    )
    per = materialise(per, "contents")
    open_rows = materialise(rows.join(per.where("with is null").select("sha256"), "sha256", "left_semi").select("sha256", "scan_ord", "name", "place"), "open")
    found = materialise(match_anywhere(open_rows, orphans), "names")
    refs = orphans.select(F.col("inner_name").alias("inner"), ref_id("ref").alias("ref_id"))
    docs = docs.select(ref_id("ref").alias("ref_id"), "raw")
    chosen = choose_sidecar(refs.join(found.select("inner").distinct(), "inner", "left_semi"), docs, ["inner"])
    by_name = found.join(chosen, "inner").select("name", F.col("ref_id").alias("found"))
    recovered = open_rows.join(by_name, "name").groupBy("sha256").agg(F.min(F.struct("scan_ord", "name", "place", "found")).alias("r"))
    pick = lambda c: F.coalesce(f"with.{c}", f"r.{c}", f"any.{c}").alias(c)
    return per.join(recovered, "sha256", "left").select(
        "sha256",
        *[pick(c) for c in ("scan_ord", "name", "place")],
        F.coalesce("with.own", "r.found").alias("sidecar"),
        (F.col("with").isNull() & F.col("r").isNotNull()).alias("recovered"),
        "bucket",
        "albums",
        "n_copies",
    )


def dedup_summary(winners: DataFrame) -> DataFrame:
    """One row: files, unique, redundant, with_sidecar, recovered, without_sidecar."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias
    return winners.agg(
        F.coalesce(F.sum("n_copies"), F.lit(0)).alias("files"),
        F.count("*").alias("unique"),
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("redundant"),
        n(F.col("sidecar").isNotNull())("with_sidecar"),
        n(F.col("recovered"))("recovered"),
        n(F.col("sidecar").isNull())("without_sidecar"),
    )


def album_manifest(winners: DataFrame) -> DataFrame:
    """(album, place): the places of each album's contents, one row each, so that no album has to fit into a task."""
    return winners.select(F.explode("albums").alias("album"), "place")
