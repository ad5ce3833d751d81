"""Lines that a metadata tool prints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that say nothing, and words of summary lines.
NOISE = ("Error opening file", "No writable tags set", "returned undef", "not defined")
SUMMARY = ("updated", "unchanged", "created", "weren't")
PROGRESS = r"\[(\d+)/(\d+)\]\s*$"
# What a line is about, by the words in it, in this order; and what is left.
MINOR = "[minor]"
TOPICS = [
    (("gps",), "GPS unreadable"),
    (("maker notes",), "maker notes unparsed"),
    (("not yet supported",), "unsupported file type (left as-is)"),
    (("ifd", "stripoffsets"), "corrupt EXIF structure"),
]
OTHER_ERRORS, OTHER_WARNINGS = "other errors", "other warnings"


def warning_category(line: Column) -> Column:
    """What a warning or error line is about; null for minor ones."""
    low = F.lower(line)
    topic = F.when(line.contains(MINOR), None)
    for words, name in TOPICS:
        topic = topic.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), name)
    return topic.when(line.startswith("Error"), OTHER_ERRORS).otherwise(OTHER_WARNINGS)


def line_class(line: Column) -> Column:
    """progress, noise, summary, warning or other."""
    t = F.trim(line)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    return (
        F.when(line.rlike(PROGRESS), "progress")
        .when((t == "") | any_of(NOISE), "noise")
        .when(any_of(SUMMARY), "summary")
        .when(t.startswith("Warning") | t.startswith("Error"), "warning")
        .otherwise("other")
    )
