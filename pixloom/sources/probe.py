"""Embedded capture dates and durations: a small reader of EXIF and of movie headers, in Arrow batches.

Files are mapped, not read: only the bytes of headers and tags are touched, whatever the length of a file. EXIF is found in JPEG, in
TIFF and the raw types built on it (CR2, NEF, ARW, DNG, ORF, RW2), in PNG, WebP, HEIC and AVIF.
"""

from __future__ import annotations

import mmap
import os
import shutil
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions.filetypes import AVIF_BRANDS, HEIC_BRANDS
from pixloom.session import spread

# TIFF tags, and the distance of the movie epoch (1904) from 1970 in seconds.
TAG_EXIF, TAG_ORIGINAL, TAG_DIGITIZED = 0x8769, 0x9003, 0x9004
MOVIE_EPOCH = 2_082_844_800
# How TIFF begins, and the raw types built on it.
TIFF_HEADS = (b"II*\0", b"MM\0*", b"IIRO", b"IIRS", b"IIU\0")
PROBED = "path string, original string, created string, duration double"


def _ifd(data: bytes, start: int, at: int, order: str, wanted: dict[int, str], out: dict[str, str]) -> int:
    """Reads the directory at `at` of the TIFF data at start; returns the place of the EXIF directory, 0 if it names none."""
    at += start
    (n,) = struct.unpack_from(order + "H", data, at)
    below = 0
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        (value,) = struct.unpack_from(order + "I", data, at + 10 + 12 * i)
        if tag == TAG_EXIF:
            below = value
        elif tag in wanted and kind == 2:
            raw = data[start + value : start + value + count] if count > 4 else data[at + 10 + 12 * i : at + 10 + 12 * i + count]
            out[wanted[tag]] = raw.split(b"\0")[0].decode("latin-1")
    return below


def read_jpeg(data: bytes) -> dict[str, str]:
    """DateTimeOriginal and CreateDate of a JPEG, as written."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return read_tiff(body[6:])
        at += 2 + size
    return {}


def read_tiff(data: bytes, start: int = 0) -> dict[str, str]:
    """The same of TIFF data that begin at start."""
    out: dict[str, str] = {}
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[start : start + 2]))
    if order is None:
        return out
    (first,) = struct.unpack_from(order + "I", data, start + 4)
    names = {TAG_ORIGINAL: "original", TAG_DIGITIZED: "created"}
    below = _ifd(data, start, first, order, names, out)
    if below:
        _ifd(data, start, below, order, names, out)
    return out


def read_png(data: bytes) -> dict[str, str]:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            return read_tiff(data[at + 8 : at + 8 + size])
        at += 12 + size
    return {}


def read_webp(data: bytes) -> dict[str, str]:
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"EXIF":
            body = data[at + 8 : at + 8 + size]
            return read_tiff(body[6:] if body[:6] == b"Exif\0\0" else body)
        at += 8 + size + size % 2
    return {}


def read_heif(data: bytes) -> dict[str, str]:
    """The first EXIF item of a HEIC or AVIF file."""
    at = data.find(b"Exif\0\0")
    while at >= 0:
        if bytes(data[at + 6 : at + 8]) in (b"II", b"MM"):
            return read_tiff(data, at + 6)
        at = data.find(b"Exif\0\0", at + 6)
    return {}


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def read_movie(data: bytes) -> dict[str, object]:
    """Creation date (UTC, in the notation of the image tags) and seconds of an ISO movie."""
    out: dict[str, object] = {}
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for inner, c, _ in _boxes(data, a, b):
            if inner == b"mvhd":
                made, _, scale, length = struct.unpack_from(">QQIQ" if data[c] == 1 else ">IIII", data, c + 4)
                if made > MOVIE_EPOCH:
                    out["created"] = datetime.fromtimestamp(made - MOVIE_EPOCH, tz=UTC).strftime("%Y:%m:%d %H:%M:%S")
                if scale:
                    out["duration"] = length / scale
    return out


def read_tags(data: bytes | None) -> dict[str, object]:
    """original, created and duration of one file's bytes, as far as they can be read."""
    try:
        head = bytes(data[:16]) if data else b""
        if head[:2] == b"\xff\xd8":
            return dict(read_jpeg(data))
        if head[:4] in TIFF_HEADS:
            return dict(read_tiff(data))
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return dict(read_png(data))
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return dict(read_webp(data))
        if head[4:8] == b"ftyp":
            return dict(read_heif(data)) if head[8:12].decode("latin-1") in HEIC_BRANDS + AVIF_BRANDS else read_movie(data)
    except (struct.error, IndexError, OverflowError, ValueError, OSError):
        pass
    return {}


def _read_entry(archive: zipfile.ZipFile, entry: str) -> dict[str, object]:
    """The tags of an entry, which lies on disk and not in memory meanwhile: archives hold long movies."""
    with archive.open(entry) as src, tempfile.TemporaryFile() as staged:
        shutil.copyfileobj(src, staged)
        staged.flush()
        if not staged.tell():
            return {}
        with mmap.mmap(staged.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return read_tags(data)


def probe_entries(places: DataFrame) -> DataFrame:
    """places(path) of `archive::entry` -> what probe gives for files. Archives must lie in a folder that all executors share.

    An archive is opened once for each run of rows that name it. Entries that cannot be read have nulls.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, archive = None, None
        for batch in batches:
            tags = []
            for place in batch["path"]:
                at, entry = place.split("::", 1)
                try:
                    if at != name:
                        if archive:
                            archive.close()
                        name, archive = None, None
                        archive = zipfile.ZipFile(at)
                        name = at
                    tags.append(_read_entry(archive, entry))
                except Exception:  # noqa: BLE001 - as a file that says nothing
                    tags.append({})
            yield _rows(batch, tags)
        if archive:
            archive.close()

    return spread(places.select("path")).sortWithinPartitions("path").mapInPandas(read, PROBED)


def _rows(batch: pd.DataFrame, tags: list[dict[str, object]]) -> pd.DataFrame:
    return pd.DataFrame({"path": batch["path"], "original": [t.get("original") for t in tags], "created": [t.get("created") for t in tags], "duration": pd.Series([t.get("duration") for t in tags], dtype="float64", index=batch.index)})


def _read_file(path: str) -> dict[str, object]:
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return {}
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return read_tags(data)


def probe_files(places: DataFrame) -> DataFrame:
    """places(path) of loose files, in a folder that all executors share -> (path, original, created, duration): one row per file,
    nulls for what cannot be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tags = []
            for path in batch["path"]:
                try:
                    tags.append(_read_file(path))
                except Exception:  # noqa: BLE001 - as a file that says nothing
                    tags.append({})
            yield _rows(batch, tags)

    return spread(places.select("path")).mapInPandas(read, PROBED)


def probe(places: DataFrame) -> DataFrame:
    """places(path) of loose files and of `archive::entry`, by the record's id -> what probe_files gives."""
    packed = F.col("path").rlike(r"(?i)\.zip::")
    return probe_files(places.where(~packed)).unionByName(probe_entries(places.where(packed)))
