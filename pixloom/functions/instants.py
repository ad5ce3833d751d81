"""Time texts in many notations -> one instant in microseconds since 1970-01-01 UTC, as column expressions."""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations in English, German, French and Spanish, by month number.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene",
    2: "feb february februar février févr fevrier fevr febrero",
    3: "mar march märz mär maerz mrz mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre setiembre set",
    10: "oct october okt oktober octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dez dezember décembre déc decembre diciembre dic",
}

# Zone abbreviations in their European or North American meaning, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

DAY_US = 86_400_000_000
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?\s*(\S.*)?$"
# Each notation is rewritten by one pass to year|month|day|hour|minute|second|fraction|am or pm|zone.
_NOTATIONS = [
    (r"^(\d{4})[:/.-](\d{1,2})[:/.-](\d{1,2})[T,]?\s*" + _TIME, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?\s*(\S.*)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{1,2})[:/.-](\d{1,2})[:/.-](\d{4}),?\s*" + _TIME, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^(?:\p{L}+\.?,? )?(\d{1,2})(?:\.|st|nd|rd|th|er)? (?:de )?(\p{L}+)\.?,? (?:de )?(\d{4}),?(?: à| at| um| a las)? " + _TIME, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^(?:\p{L}+\.?, )?(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4}),?(?: at)? " + _TIME, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"^\p{L}+,? (\p{L}+) (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?(?: ([A-Z]{1,5}|[+-]\d{2}:?\d{2}))? (\d{4})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
]
_COUNT = r"^[+-]?\d+(?:\.\d*)?$"
_OFFSET = r"^(?:UTC|GMT|Z)?([+-])(\d{1,2})(?::?(\d{2}))?(?:\[[^\]]*\])?$"


@lru_cache(1)
def _zone_list() -> str:
    """Names of the public time zone database, between commas: one literal instead of hundreds keeps the plan small."""
    return "," + ",".join(sorted(z for z in available_timezones() if "/" in z and not z.startswith(("posix", "right", "SystemV")))) + ","


def _is_zone(name: Column) -> Column:
    return name.rlike(r"^[A-Z]\w+(?:/[\w+-]+)+$") & F.contains(F.lit(_zone_list()), F.concat(F.lit(","), name, F.lit(",")))


@lru_cache(1)
def _month_map() -> dict[str, int]:
    return {name: number for number, names in MONTHS.items() for name in names.split()}


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def tidy(text: Column) -> Column:
    """Trimmed, with every run of white space (narrow and non-breaking too) as one blank and plain signs and digits."""
    text = F.translate(text, "−年月時分日秒\u200e\u200f", "-//:: ")
    return F.trim(F.regexp_replace(text, r"[\s\u00a0\u2007\u2009\u202f\u3000]+", " "))


def parse_zone(text: Column) -> Column:
    """STRUCT<off INT minutes east, name STRING>: an offset wins over a name; both null if the text names no zone."""
    z = F.trim(text)
    # sign|hours|minutes by one pass over what looks like an offset
    cut = F.when(z.rlike(_OFFSET), F.split(F.regexp_replace(z, _OFFSET, "$1|$2|$3"), r"\|", 3))
    minutes = F.coalesce(F.get(cut, F.lit(2)).try_cast("int"), F.lit(0))
    total = F.when(F.get(cut, F.lit(0)) == "-", -1).otherwise(1) * (F.get(cut, F.lit(1)).try_cast("int") * 60 + minutes)
    off = F.when(cut.isNotNull(), F.when((F.abs(total) <= 18 * 60) & (minutes < 60), total)).otherwise(_lookup(ABBREVIATIONS, F.upper(z)))
    name = F.regexp_replace(z, r"^\[(.*)\]$", "$1")
    return F.struct(off.cast("int").alias("off"), F.when(off.isNull() & _is_zone(name), name).alias("name"))


def split_time(text: Column, short_counts: Column) -> Column:
    """One time text -> ARRAY of year, month, day, hour, minute, second, fraction, am/pm, zone; or of one count; or null.

    short_counts: whether a plain number of eight digits or fewer is a count of seconds (it is a partial date in image tags).
    """
    digits = F.length(F.regexp_extract(text, r"^[+-]?(\d+)", 1))
    is_count = text.rlike(_COUNT) & ~text.rlike(r"^(19|20)\d{12}$")
    out = F.when(is_count & (short_counts | (digits >= 9)), F.array(text))
    for pattern, order in _NOTATIONS:
        out = out.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, order), r"\|", 9))
    return out


def count_us(text: Column) -> Column:
    """A count of seconds, milliseconds or microseconds since 1970 (told apart by its digits), exact to the digits written."""
    number = F.regexp_replace(text, r"\.$", "").try_cast("decimal(38,9)")
    digits = F.length(F.regexp_extract(text, r"^[+-]?(\d+)", 1))
    unit = F.when(digits <= 11, F.lit(1_000_000)).when(digits <= 14, F.lit(1000)).when(digits <= 17, F.lit(1))
    return F.floor(number * unit).cast("bigint")


def local_us(parts: Column) -> Column:
    """The wall clock reading in microseconds, as if it were UTC; null for an impossible date or time of day."""
    number = lambda k: parts[k].try_cast("int")
    half = F.upper(F.substring(parts[7], 1, 1))
    hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "P", 12).otherwise(0))
    month = F.coalesce(number(1), _lookup(_month_map(), F.lower(parts[1])))
    second = F.when(parts[5] == "", F.lit(0)).otherwise(number(5))
    fraction = F.rpad(F.substring(parts[6], 1, 6), 6, "0").try_cast("int")
    # a time of 24:00 or a second of 60 is no reading of a camera clock
    whole = F.try_make_timestamp(number(0), month, number(2), hour, number(4), second, F.lit("UTC"))
    return F.when((number(0) >= 1) & (hour < 24) & (second < 60), F.unix_micros(whole) + fraction)


def to_utc_us(local: Column, off: Column, name: Column) -> Column:
    """A wall clock reading at an offset or in a named zone -> the instant; the earlier one where it occurs twice, null where it was skipped."""
    wall = F.timestamp_micros(local)
    utc = F.to_utc_timestamp(wall, name)
    return F.when(off.isNotNull(), local - off.cast("bigint") * 60_000_000).when(
        name.isNotNull() & (F.from_utc_timestamp(utc, name) == wall), F.unix_micros(utc)
    )
