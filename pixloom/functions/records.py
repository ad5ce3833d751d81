"""Column expressions for what identifies a media record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_id() -> Column:
    """The path of a loose file, else `archive::entry`; null if the record names neither."""
    return F.coalesce(F.col("path"), F.concat(F.col("zip"), F.lit("::"), F.col("entry")))


def ref_id(ref: str) -> Column:
    """The same for a STRUCT<kind, path, zip, entry>."""
    return F.coalesce(F.col(f"{ref}.path"), F.concat(F.col(f"{ref}.zip"), F.lit("::"), F.col(f"{ref}.entry")))


def clean_hash(text: Column) -> Column:
    """A SHA-256 in any letter case, with a prefix, blanks or separators, as 64 lower-case hex digits; null if it is none."""
    bare = F.regexp_replace(F.lower(text), r"^\s*(sha-?256|hash)\s*[:=/-]?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\s*(0x|\\x)", ""), r"[^0-9a-z]", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)
