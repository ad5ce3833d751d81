"""Loose files and archives as rows: hash, first bytes and place, without content."""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections import deque
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixloom.functions import filetypes as T
from pixloom.functions import paths as P
from pixloom.operators.matching import match_in_folder, orphan_sidecars
from pixloom.session import materialise, spread

CHUNK = 1 << 16
ENTRIES_PER_TASK = 2_000
BYTES_PER_TASK = 512 << 20
FOLDERS_PER_TASK, ROWS_AT_ONCE = 1_000, 50_000
FOUND = "zip string, entry string, path string, name string, length bigint, sha256 string, head binary, raw string, error string"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below root, of any size and name (Spark's own listing leaves out names that begin with _ or .);
    no content is read. Folders that cannot be listed give no rows; links to folders are not followed.

    Tasks walk folders breadth first. Each goes on for FOLDERS_PER_TASK folders and hands the rest to the next round, so a small tree
    is one task and a large one is shared by all; root must be a folder that all executors share.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["path"]:
                waiting, seen, rows = deque([top]), 0, []
                while waiting:
                    folder = waiting.popleft()
                    seen += 1
                    if seen > FOLDERS_PER_TASK:
                        rows.append((folder, 0, True))
                        continue
                    try:
                        with os.scandir(folder) as entries:
                            for e in entries:
                                if e.is_dir(follow_symlinks=False):
                                    waiting.append(e.path)
                                elif e.is_file():
                                    rows.append((e.path, e.stat().st_size, False))
                                if len(rows) >= ROWS_AT_ONCE:
                                    yield pd.DataFrame(rows, columns=["path", "length", "folder"])
                                    rows = []
                    except OSError:
                        pass
                yield pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"path": "object", "length": "int64", "folder": "bool"})

    folders, found = spark.createDataFrame([(os.path.abspath(root),)], "path string"), None
    while True:
        level = materialise(spread(folders).mapInPandas(walk, "path string, length bigint, folder boolean"), "listing")
        files = level.where("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return found


def _shared(files: DataFrame) -> DataFrame:
    """files(path, length) over tasks of like amounts of bytes and files."""
    n, size = files.agg(F.count("*"), F.sum("length")).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-n // ENTRIES_PER_TASK), (size or 0) // BYTES_PER_TASK)
    return files.repartition(min(tasks, 100_000), "path")


def _is_media(name: str) -> bool:
    low = name.lower()
    return any(low.endswith("." + e) for e in T.PHOTO + T.VIDEO)


def _read_through(f: BinaryIO, keep: bool) -> tuple[str, bytes, str | None]:
    """(hash, first bytes, the text if it is to be kept) of a stream, read by chunks whatever its length."""
    digest, head, text = hashlib.sha256(), b"", []
    while chunk := f.read(CHUNK):
        digest.update(chunk)
        head = head or chunk[: T.HEAD_BYTES]
        if keep:
            text.append(chunk)
    return digest.hexdigest(), head, b"".join(text).decode("utf-8", "replace") if keep else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")], dtype="object")


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def loose_files(spark: SparkSession, root: str) -> DataFrame:
    """FOUND of media files and sidecars (.json, letter case as it is) below root, read once each; raw of sidecars only.

    A file that cannot be read gives a row with an error. Files are opened by path, so root must be a folder that all executors share.
    """
    wanted = _shared(listing(spark, root).where(T.is_media(P.base_name(F.col("path"))) | F.endswith("path", F.lit(".json"))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    with open(path, "rb") as f:
                        rows.append((None, None, path, name, length, *_read_through(f, not _is_media(name)), None))
                except Exception as e:  # noqa: BLE001 - reported as a row
                    rows.append((None, None, path, name, length, None, None, None, _why(e)))
            yield _frame(rows)

    return wanted.mapInPandas(read, FOUND)


def zip_entries(archives: DataFrame, entries_per_task: int = ENTRIES_PER_TASK, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """FOUND of the media files and sidecars in archives(path), of any size and number; raw of sidecars only.

    Archives are opened by the tasks: first for their lists of entries, which are cut into ranges of like work, then each range is
    one task's share, so a large archive is many tasks. Broken archives and entries give rows with an error.
    """
    schema = "path string, first int, last int, error string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with zipfile.ZipFile(path) as z:
                        first = size = at = 0
                        for at, info in enumerate(z.infolist(), 1):
                            size += info.file_size
                            if at - first >= entries_per_task or size >= bytes_per_task:
                                rows.append((path, first, at, None))
                                first, size = at, 0
                        if at > first:
                            rows.append((path, first, at, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, 0, _why(e)))
            yield pd.DataFrame(rows, columns=["path", "first", "last", "error"]).astype({"first": "int32", "last": "int32"})

    ranges = materialise(archives.select("path").mapInPandas(cut, schema), "ranges")
    shared = ranges.repartition(max(1, min(ranges.count(), 20_000)), "path", "first")

    def entry(z: zipfile.ZipFile, path: str, info: zipfile.ZipInfo) -> tuple:
        name = info.filename.rsplit("/", 1)[-1]
        try:
            with z.open(info) as f:
                return (path, info.filename, None, name, info.file_size, *_read_through(f, not _is_media(name)), None)
        except Exception as e:  # noqa: BLE001
            return (path, info.filename, None, name, info.file_size, None, None, None, _why(e))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, last, error in batch.itertuples(index=False):
                if error:
                    yield _frame([(path, None, None, None, None, None, None, None, error)])
                    continue
                with zipfile.ZipFile(path) as z:
                    wanted = [i for i in z.infolist()[first:last] if not i.is_dir() and (_is_media(i.filename) or i.filename.endswith(".json"))]
                    yield _frame([entry(z, path, i) for i in wanted])

    return shared.mapInPandas(read, FOUND)


def number_rows(df: DataFrame, order: list, to: str = "scan_ord") -> DataFrame:  # noqa: ANN001 - columns
    """df with `to`: 1, 2, ... in the given order, without sorting in one task.

    Rows are sorted by ranges and written; each range counts its rows, and a row's number is its rank in its range plus the
    rows of earlier ranges. What is broadcast has one row per range.
    """
    placed = materialise(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_p").withColumn(to, F.col("_start") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_first", "_start")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(copies, orphans, docs, errors) of a tree of folders and archives, in the columns of the domain tables.

    Every file and every archive's entry is read once: what was found is written before it is used. scan_ord numbers the copies by
    kind (folders before archives), container and name, so it does not depend on the file system; it is this scan's own (see
    sources.inventory for numbers that last). Trees without archives, or without loose files, are trees.
    """
    root = os.path.abspath(root)
    archives = listing(spark, root).where(F.endswith(F.lower("path"), F.lit(".zip"))).select("path")
    found = materialise(loose_files(spark, root).unionByName(zip_entries(archives)), "found")
    at = F.struct(F.when(F.col("zip").isNull(), "dir").otherwise("zip").alias("kind"), "path", "zip", "entry")
    inside = F.coalesce("path", "entry")
    rows = found.where("error is null").select("*", at.alias("ref"), F.concat_ws("::", "zip", P.folder_of(inside)).alias("folder"))
    media = rows.where("raw is null").select(F.col("ref.kind").alias("src"), "path", "zip", "entry", "name", "sha256", "head", "folder")
    docs = rows.where("raw is not null").select("ref", "raw", "folder", F.col("name").alias("json"))
    matched = match_in_folder(media, docs).select("folder", "name", F.col("sidecar").alias("json"))
    refs = docs.select("folder", "json", "ref")
    with_ref = media.join(matched, ["folder", "name"], "left").join(refs, ["folder", "json"], "left")
    now = F.current_timestamp().alias("scanned_at")
    copies = number_rows(with_ref, [F.when(F.col("src") == "dir", 0).otherwise(1), F.col("folder"), F.col("name")]).select(
        "scan_ord", "sha256", "src", "path", "zip", "entry", "name", "head", T.sniff_type(F.col("head")).alias("true_ext"), P.path_bucket(P.place()).alias("bucket"), F.col("ref").alias("sidecar"), now
    )
    left = orphan_sidecars(media, docs).join(refs, ["folder", "json"]).select(F.col("inner").alias("inner_name"), "ref")
    order = [F.col("ref.kind"), F.coalesce("ref.path", "ref.zip"), F.col("ref.entry")]
    orphans = number_rows(left, order).select("scan_ord", "inner_name", "ref")
    numbered = number_rows(docs.select("ref", "raw"), order, "sidecar_id").select("sidecar_id", "ref", "raw")
    errors = found.where("error is not null").select(F.lit("read_error").alias("category"), F.coalesce("path", F.concat_ws("::", "zip", "entry")).alias("ident"), F.col("error").alias("detail"))
    return copies, orphans, numbered, errors
