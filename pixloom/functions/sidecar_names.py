"""How sidecar files are named after media files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The long ending of sidecar names, which may be cut anywhere; the least stem length to trust a cut name.
LONG_ENDING = ".supplemental-metadata"
MIN_CUT_STEM = 30
PLAIN, CUT, EDITED = 0, 1_000, 2_000


def endings() -> list[str]:
    """Every beginning of the long ending, longest first, the empty one last."""
    return [LONG_ENDING[:k] for k in range(len(LONG_ENDING), -1, -1)]


def inner_name(json_name: Column) -> Column:
    """The media name a sidecar is named after: without .json and the longest cut of the long ending; null if it is no .json."""
    body = F.regexp_replace(json_name, r"\.json$", "")
    cuts = "|".join(e.replace(".", r"\.") for e in endings() if e)
    return F.when(json_name.endswith(".json"), F.regexp_replace(body, f"(?s)(?:{cuts})$", ""))


def named_media(json_name: Column) -> Column:
    """ARRAY<STRUCT<media, rank>>: every media name for which this sidecar would be looked up, with the place in that lookup.

    A name is looked up as name + ending, longest ending first; then, if it has a counter before its extension, with the counter
    moved behind the extension, before and after each ending. Reading a sidecar's name backwards gives those media names directly,
    a handful instead of up to 69 candidates for each media file.
    """
    body = F.regexp_replace(json_name, r"\.json$", "")
    counted = r"(?s)^(.*)(\.[^.]+)(\(\d+\))$"
    moved = lambda text: F.when(text.rlike(counted), F.regexp_replace(text, counted, "$1$3$2"))
    tail = F.regexp_extract(body, r"(\(\d+\))$", 1)
    bare = F.when(tail != "", F.left(body, F.length(body) - F.length(tail)))
    cut = lambda text, e: F.when(F.endswith(text, e) & (F.length(text) > F.length(e)), F.left(text, F.length(text) - F.length(e)))
    row = lambda media, rank: F.struct(media.alias("media"), rank.alias("rank"))
    # lambdas over the few endings that fit, not 69 expressions of one projection
    ends = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(i).alias("i")) for i, e in enumerate(endings())])
    fit = F.filter(ends, lambda x: F.endswith(body, x["e"]) | F.coalesce(F.endswith(bare, x["e"]), F.lit(False)))
    found = F.transform(
        fit,
        lambda x: F.array(
            row(cut(body, x["e"]), x["i"]), row(moved(cut(body, x["e"])), 23 + 2 * x["i"]), row(moved(F.concat(cut(bare, x["e"]), tail)), 24 + 2 * x["i"])
        ),
    )
    return F.when(json_name.endswith(".json"), F.filter(F.flatten(found), lambda x: x["media"].isNotNull()))


def sidecar_dest(media: Column, original: Column) -> Column:
    """The sidecar's name beside a placed file: with the long ending if the original had all of it."""
    return F.concat(media, F.when(F.contains(original, F.lit(LONG_ENDING)), F.lit(LONG_ENDING + ".json")).otherwise(F.lit(".json")))
