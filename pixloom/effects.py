"""File effects of a written plan. Decisions are made by DataFrames; these functions only carry them out, and may be repeated."""

from __future__ import annotations

import filecmp
import hashlib
import os
import shutil
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame

from pixloom.session import spread

CHUNK = 1 << 20
ROWS_PER_TASK = 2_000


class _Archives:
    """The archive that was opened last: rows come sorted by source, so each is opened once a task."""

    def __init__(self) -> None:
        self.path, self.open = "", None

    def entry(self, source: str) -> BinaryIO:
        path, name = source.split("::", 1)
        if path != self.path:
            self.close()
            self.open = zipfile.ZipFile(path)
            self.path = path
        return self.open.open(name)

    def close(self) -> None:
        if self.open:
            self.open.close()
        self.path, self.open = "", None


def _same(source: str, target: str, archives: _Archives) -> bool:
    """Whether the target holds what the source does; a source that is gone was moved before."""
    if "::" not in source:
        return not os.path.exists(source) or filecmp.cmp(source, target, shallow=False)
    with archives.entry(source) as a, open(target, "rb") as b:
        while (x := a.read(CHUNK)) == b.read(CHUNK):
            if not x:
                return True
    return False


def _put(source: str, target: str, action: str, archives: _Archives) -> str:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.part-{os.getpid()}"
    try:
        if os.path.exists(target):
            return "present" if action == "keep" or _same(source, target, archives) else "failed: the target holds something else"
        if "::" in source:
            with archives.entry(source) as src, open(part, "wb") as dst:
                shutil.copyfileobj(src, dst)
        elif action == "link":
            os.link(source, part)
        elif action == "move":
            os.replace(source, target) if os.stat(source).st_dev == os.stat(os.path.dirname(target)).st_dev else _move_across(source, part, target)
            return "done"
        else:
            shutil.copy2(source, part)
        os.replace(part, target)  # a target is whole or absent
        return "done"
    except Exception as e:  # noqa: BLE001 - reported as a row
        if os.path.exists(part):
            os.unlink(part)
        return f"failed: {type(e).__name__}: {e}"


def _move_across(source: str, part: str, target: str) -> None:
    """To another device: the source goes only when the target is whole."""
    shutil.copy2(source, part)
    os.replace(part, target)
    os.unlink(source)


def carry_out(plan: DataFrame, root: str) -> DataFrame:
    """plan(source, rel_path, action) -> (rel_path, outcome): copies, links or moves each source to root/rel_path.

    The plan must be a written table. root must be a folder that all executors share. Sources are left as they are unless the
    action is move; a target that exists is kept: it is present if it holds the same bytes (or the action is `keep`, a copy that
    gives way to anything), else the row has failed.
    """
    rows = plan.select("source", "rel_path", "action")
    tasks = max(plan.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = _Archives()
        for b in batches:
            yield pd.DataFrame({"rel_path": b["rel_path"], "outcome": [_put(s, os.path.join(root, r), a, archives) for s, r, a in zip(b["source"], b["rel_path"], b["action"])]})
        archives.close()

    return rows.repartitionByRange(tasks, "source", "rel_path").sortWithinPartitions("source").mapInPandas(work, "rel_path string, outcome string")


def files_in(folders: DataFrame, root: str) -> DataFrame:
    """folders(folder) -> (folder, name) of the files that lie in root/folder itself; no content is read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                at = os.path.join(root, folder)
                names = [e.name for e in os.scandir(at) if e.is_file()] if os.path.isdir(at) else []
                yield pd.DataFrame({"folder": [folder] * len(names), "name": names}, dtype="object")

    return folders.where("folder is not null").select("folder").distinct().mapInPandas(work, "folder string, name string")


def first_bytes(files: DataFrame, n: int) -> DataFrame:
    """files(path) -> (path, head): the first n bytes of each file, null if it cannot be read."""

    def head(path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read(n)
        except OSError:
            return None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "head": [head(p) for p in b["path"]]})

    return spread(files.select("path")).mapInPandas(work, "path string, head binary")


def hashed(files: DataFrame, root: str) -> DataFrame:
    """files(folder, name) -> (folder, name, sha256) of what lies below root; null for what cannot be read."""

    def digest(path: str) -> str | None:
        try:
            with open(path, "rb") as f:
                return hashlib.file_digest(f, "sha256").hexdigest()
        except OSError:
            return None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sha256=[digest(os.path.join(root, f, n)) for f, n in zip(b["folder"], b["name"])])

    return spread(files.select("folder", "name")).mapInPandas(work, "folder string, name string, sha256 string")
