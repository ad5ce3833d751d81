"""Short clips that belong to a still picture of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.functions import filetypes as T
from pixloom.functions import paths as P

MAX_SECONDS = 4.0


def is_motion(media: DataFrame, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """media(name, duration, ...) with motion: a video of a known, short duration whose stem is that of some photo.

    Stems are compared with letter case. A left join with the distinct photo stems, not an existence test per row.
    """
    stems = media.where(T.media_kind(P.suffix(F.col("name"))) == "photos").select(P.stem(F.col("name")).alias("_stem")).where("_stem is not null").distinct().withColumn("_still", F.lit(True))
    video = T.media_kind(P.suffix(F.col("name"))) == "videos"
    found = media.withColumn("_stem", F.when(video, P.stem(F.col("name")))).join(stems, "_stem", "left")
    return found.withColumn("motion", F.coalesce(video & F.col("_still") & (F.col("duration") <= max_seconds), F.lit(False))).drop("_stem", "_still")


def disposition(motion: Column, has_sidecar: Column, mode: str) -> Column:
    """What becomes of a clip: mode (archive, drop or errors) for motion clips without sidecar, else null (keep: always null)."""
    if mode == "keep":
        return F.lit(None).cast("string")
    return F.when(motion & ~has_sidecar, F.lit(mode))
