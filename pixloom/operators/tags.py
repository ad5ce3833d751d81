"""Which tags a sidecar puts into its media file."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.functions import dates as D
from pixloom.functions import filetypes as T
from pixloom.functions import paths as P

# Tag names.
PHOTO_DATES = ("DateTimeOriginal", "CreateDate")
VIDEO_DATES = ("QuickTime:CreateDate", "QuickTime:ModifyDate", "TrackCreateDate", "TrackModifyDate", "MediaCreateDate", "MediaModifyDate")
CAPTIONS = ("IPTC:Caption-Abstract", "XMP-dc:Description", "EXIF:ImageDescription")


def guarded_ts(raw: Column, min_year: int = D.MIN_YEAR, now: int | None = None) -> Column:
    """photoTakenTime if it lies between the first allowed year and two days from now, else null."""
    ts = D.sidecar_ts(raw, "photoTakenTime")
    latest = (now if now is not None else int(datetime.now(tz=UTC).timestamp())) + 2 * 86_400
    return F.when(ts.between(int(datetime(min_year, 1, 1, tzinfo=UTC).timestamp()), latest), ts)


def tag_plan(media: DataFrame, min_year: int = D.MIN_YEAR, now: int | None = None) -> DataFrame:
    """media(id, name, raw) -> (id, tag, value): one row per tag to write.

    Photos: the two dates, each coordinate and the altitude unless it is 0, a caption in three tags unless it is empty, a rating
    of 5 if favorited, and each person's name. Videos: six dates and the description. Unreadable documents give no rows.
    """
    photo = T.media_kind(P.suffix(F.col("name"))) == "photos"
    get = lambda path: F.get_json_object("raw", path)
    ts = guarded_ts(F.col("raw"), min_year, now).cast("string")
    row = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))
    number = lambda path: F.when(get(path).try_cast("double") != 0, get(path))
    caption = F.nullif(get("$.description"), F.lit(""))
    lat, lon = number("$.geoData.latitude"), number("$.geoData.longitude")
    stars = F.when(get("$.favorited").isNotNull() & (get("$.favorited") != "false"), F.lit("5"))
    people = F.from_json(get("$.people"), "array<struct<name:string>>")
    for_photo = F.concat(
        F.array(
            *[row(t, ts) for t in PHOTO_DATES],
            row("GPSAltitude", number("$.geoData.altitude")),
            row("GPSLatitude", lat),
            row("GPSLongitude", lon),
            row("GPSLatitudeRef", lat),
            row("GPSLongitudeRef", lon),
            *[row(t, caption) for t in CAPTIONS],
            row("XMP:Rating", stars),
        ),
        F.coalesce(F.transform(people, lambda p: row("XMP-iptcExt:PersonInImage", p["name"])), F.array().cast("array<struct<tag:string,value:string>>")),
    )
    for_video = F.array(*[row(t, ts) for t in VIDEO_DATES], row("QuickTime:Description", caption))
    return media.select("id", F.inline(F.when(photo, for_photo).otherwise(for_video))).where("value is not null")
