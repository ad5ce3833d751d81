"""Capture dates: plausible epochs, sidecar times and embedded date texts, as column expressions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the first year in which a date is taken for a camera's.
MIN_YEAR = 1995
INTEGER = r"^\s*[+-]?\d+\s*$"


def default_max_year() -> int:
    return datetime.now(tz=UTC).year + 1


def _epoch(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=UTC).timestamp())


def plausible_year(year: Column, min_year: int = MIN_YEAR, max_year: int | None = None) -> Column:
    return F.coalesce(year.between(min_year, max_year or default_max_year()), F.lit(False))


def plausible_ts(ts: Column, min_year: int = MIN_YEAR, max_year: int | None = None) -> Column:
    """Whether seconds since 1970 lie in the years allowed; compared as numbers, so nothing overflows."""
    inside = (ts > 0) & (ts >= _epoch(min_year)) & (ts < _epoch((max_year or default_max_year()) + 1))
    return F.coalesce(inside, F.lit(False))


def sidecar_ts(raw: Column, key: str) -> Column:
    """The whole number of seconds at key.timestamp of a JSON text; null for anything else, malformed and non-object texts too."""
    text = F.try_variant_get(F.try_parse_json(raw), f"$.{key}.timestamp", "string")
    return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))


def year_month(ts: Column) -> Column:
    """STRUCT<year INT, month INT> in UTC of seconds since 1970."""
    at = F.timestamp_seconds(ts)
    return F.struct(F.year(at).alias("year"), F.month(at).alias("month"))


def sidecar_date(raw: Column, min_year: int = MIN_YEAR, max_year: int | None = None) -> Column:
    """The month of photoTakenTime if that can be read (null if it is implausible), else of a plausible creationTime."""
    taken, made = sidecar_ts(raw, "photoTakenTime"), sidecar_ts(raw, "creationTime")
    return F.when(
        taken.isNotNull(), F.when(plausible_ts(taken, min_year, max_year), year_month(taken))
    ).when(plausible_ts(made, min_year, max_year), year_month(made))


def embedded_text(original: Column, created: Column) -> Column:
    """DateTimeOriginal unless it is missing or empty, else CreateDate; zeros count as a value."""
    return F.coalesce(F.nullif(original, F.lit("")), F.nullif(created, F.lit("")))


def embedded_date(text: Column, min_year: int = MIN_YEAR, max_year: int | None = None) -> Column:
    """Year and month read by position (characters 1-4 and 6-7 of the trimmed text), separators unchecked; null if implausible."""
    t = F.trim(text)
    year, month = F.substring(t, 1, 4), F.substring(t, 6, 2)
    readable = (F.length(text) >= 7) & year.rlike(r"^\d{4}$") & F.trim(month).rlike(r"^\+?\d+$")
    y, m = year.try_cast("int"), F.trim(month).try_cast("int")
    return F.when(readable & m.between(1, 12) & plausible_year(y, min_year, max_year), F.struct(y.alias("year"), m.alias("month")))


def date_waterfall(from_sidecar: Column, from_file: Column, has_sidecar: Column, include_undated: bool = False) -> Column:
    """STRUCT<outcome, year, month>: dated by sidecar, else dated by file, else unknown (with a sidecar, or if asked for), else error."""
    none = F.lit(None).cast("int")
    made = lambda outcome, y, m: F.struct(F.lit(outcome).alias("outcome"), y.alias("year"), m.alias("month"))
    return (
        F.when(from_sidecar.isNotNull(), made("sidecar", from_sidecar["year"], from_sidecar["month"]))
        .when(from_file.isNotNull(), made("embedded", from_file["year"], from_file["month"]))
        .when(has_sidecar | F.lit(include_undated), made("unknown", none, none))
        .otherwise(made("error", none, none))
    )
