"""File names, folders and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are no albums, folders that are skipped in error paths, characters that file systems forbid.
NO_ALBUM = ("takeout", "google photos", "trash", "archive")
SKIPPED_FOLDERS = ("Takeout", "Google Photos")
TIMELINE = r"^photos from \d{4}$"
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def suffix(name: Column) -> Column:
    """The last extension with its dot; empty for names without, with a leading or with a trailing dot only."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    """The name of the folder that holds the path; empty where there is none."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def place(src: str = "src", path: str = "path", entry: str = "entry") -> Column:
    """The path within its container: path of a loose file, entry of an archived one."""
    return F.when(F.col(src) == "dir", F.col(path)).otherwise(F.col(entry))


def path_bucket(path: Column) -> Column:
    """trash if any component is that in any letter case, else archive likewise, else null."""
    parts = F.split(F.lower(path), "/")
    return F.when(F.array_contains(parts, "trash"), "trash").when(F.array_contains(parts, "archive"), "archive")


def album_of(path: Column) -> Column:
    """The folder a file lies in, unless that is structural, the trash, the archive or a year of the timeline; else null."""
    name = parent_name(path)
    low = F.lower(name)
    return F.when((name != "") & ~low.isin(*NO_ALBUM) & ~low.rlike(TIMELINE), name)


def safe_album(name: Column) -> Column:
    """An album's name as a folder name: forbidden characters become _, no blanks around, no dots or blanks at the end."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, FORBIDDEN, "_")), r"[. ]+$", "")
    return F.when(clean == "", F.lit("_album")).otherwise(clean)


def errors_path(src: Column, path: Column, zip_path: Column, entry: Column, root: str) -> Column:
    """Where a failed file is mirrored below the errors folder: its path below root without structural folders; files of an
    archive go below the archive's stem if it lies in root itself, else below its first folder."""
    below = lambda p: F.regexp_replace(p, "^" + root.rstrip("/") + "/", "")
    keep = lambda p: F.filter(F.split(p, "/"), lambda x: ~x.isin(*SKIPPED_FOLDERS))
    rel = below(zip_path)
    top = F.when(F.contains(rel, F.lit("/")), F.element_at(F.split(rel, "/"), 1)).otherwise(stem(rel))
    return F.when(src == "dir", F.array_join(keep(below(path)), "/")).otherwise(F.array_join(F.concat(F.array(top), keep(entry)), "/"))


def human_size(n: Column) -> Column:
    """Bytes as a whole number of B, or KB, MB, GB to one decimal, base 1024."""
    out = F.format_string("%.1f GB", n / F.lit(1024.0**3))
    for power, unit in ((2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / F.lit(1024.0**power))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)
