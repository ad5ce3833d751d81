"""Tools for a library that is there: mistaken extensions, files without month, look-alikes. Each gives a table of moves first."""

from __future__ import annotations

import os
import shlex
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.effects import carry_out, files_in, first_bytes
from pixloom.functions import dates as D
from pixloom.functions import filetypes as T
from pixloom.functions import paths as P
from pixloom.operators import neardup, placement, review
from pixloom.session import materialise
from pixloom.sources.files import listing
from pixloom.sources.images import fingerprints
from pixloom.sources.probe import probe_files

PHOTOS, GROUPS = "final/photos", "near-dup-groups"


def media_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, name) of the media files below root."""
    name = P.base_name(F.col("path"))
    return listing(spark, os.path.abspath(root)).where(T.is_media(name)).select("path", name.alias("name"))


def _numbered(moves: DataFrame, root: str) -> DataFrame:
    """moves(source, folder, name, ...) below root with rel_path: names that are taken, there or by another move, get the next number."""
    rows = materialise(moves.withColumn("sha256", F.sha2("source", 256)), "moves")
    files = materialise(files_in(rows, root), "files")
    none = files.limit(0).withColumn("sha256", F.lit(None).cast("string"))
    placed = placement.number_beside(rows, files, none, ["source"])
    return placed.select(*moves.columns, F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), "final_name").alias("rel_path"))


def _below(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def extension_moves(spark: SparkSession, root: str) -> DataFrame:
    """(source, folder, name, was, want, rel_path): the media files below root whose extension is not that of their content, and their new name."""
    root = os.path.abspath(root)
    heads = materialise(first_bytes(media_below(spark, root), T.HEAD_BYTES), "heads")
    found = heads.select("path", P.base_name(F.col("path")).alias("old"), T.sniff_type(F.col("head")).alias("type"))
    named = found.withColumn("name", T.corrected_name(F.col("old"), F.col("type"))).where("name <> old")
    was = F.regexp_replace(F.lower(P.suffix(F.col("old"))), r"^\.+", "")
    return _numbered(named.select(F.col("path").alias("source"), P.folder_of(_below(F.col("path"), root)).alias("folder"), "name", was.alias("was"), F.col("type").alias("want")), root)


def undated_moves(spark: SparkSession, final: str, min_year: int = D.MIN_YEAR) -> tuple[DataFrame, DataFrame]:
    """((source, folder, name, year, rel_path) of the files in photos/unknown and videos/unknown whose embedded date is plausible,
    (path) of those that stay)."""
    final = os.path.abspath(final)
    files = media_below(spark, final).withColumn("kind", F.regexp_extract(_below(F.col("path"), final), "^(photos|videos)/unknown/", 1)).where("kind <> ''")
    read = probe_files(files).select("path", D.embedded_date(D.embedded_text(F.col("original"), F.col("created")), min_year).alias("day"))
    rows = materialise(files.join(read, "path"), "dated")
    folder = F.concat_ws("/", "kind", F.col("day.year").cast("string"), F.lpad(F.col("day.month").cast("string"), 2, "0"))
    return _numbered(rows.where("day is not null").select(F.col("path").alias("source"), folder.alias("folder"), "name", F.col("day.year").alias("year")), final), rows.where("day is null").select("path")


def apply_moves(moves: DataFrame, root: str) -> DataFrame:
    """(rel_path, outcome) of the moves(source, rel_path), carried out."""
    written = materialise(moves.select("source", "rel_path", F.lit("move").alias("action")), "moves")
    return materialise(carry_out(written, os.path.abspath(root)), "moved")


def look_alikes(spark: SparkSession, root: str, distance: int = neardup.MAX_DISTANCE, color: int | None = neardup.MAX_COLOR) -> DataFrame:
    """(group_id, path, size, w, h, rank_no, suggest_keep) of the groups of similar pictures below root, largest file first."""
    root = os.path.abspath(root)
    prints = materialise(fingerprints(spark, root), "prints")
    groups = neardup.similar_groups(prints.select(F.col("path").alias("id"), "words", "color"), distance, color).withColumnRenamed("id", "path")
    sizes = listing(spark, root).withColumnRenamed("length", "size")
    return materialise(review.registry(groups.join(sizes, "path").join(prints.select("path", "w", "h"), "path")), "groups")


def save_groups(groups: DataFrame, root: str, at: str) -> None:
    """The groups as lines of JSON, with paths below root."""
    groups.withColumn("path", _below(F.col("path"), os.path.abspath(root))).write.mode("overwrite").json(at)


def load_groups(spark: SparkSession, at: str, root: str) -> DataFrame:
    """Groups that were saved, of which two or more files are still there."""
    root = os.path.abspath(root)
    rows = spark.read.schema("group_id string, path string, size bigint, w int, h int, rank_no int, suggest_keep boolean").json(at)
    return review.present_groups(rows.withColumn("path", F.concat(F.lit(root + "/"), "path")), listing(spark, root))


def removal_moves(groups: DataFrame, selection: DataFrame, removed: str) -> DataFrame:
    """(source, folder, name, rel_path): the selected(path) files of the groups, to the folder that keeps what was removed. Others are ignored."""
    known = groups.join(selection.select("path").distinct(), "path", "left_semi")
    return _numbered(known.select(F.col("path").alias("source"), F.lit("").alias("folder"), P.base_name(F.col("path")).alias("name")), os.path.abspath(removed))


def prepare_review(spark: SparkSession, output: str, scan: bool) -> DataFrame | None:
    """The groups of look-alikes of a library, saved with a launcher of their review; without scan the launcher alone."""
    photos, at = f"{output}/{PHOTOS}", f"{output}/{GROUPS}"
    if not os.path.isdir(photos):
        return None
    groups = None
    if scan:
        groups = look_alikes(spark, photos)
        save_groups(groups, photos, at)
    command = [sys.executable, "-m", "pixloom.cli", "similar", "--dir", photos, *(["--groups", at] if scan else [])]
    launcher = f"{output}/review-similar.sh"
    with open(launcher, "w") as f:
        f.write("#!/bin/sh\n" + shlex.join(command) + "\n")
    os.chmod(launcher, 0o755)
    return groups
