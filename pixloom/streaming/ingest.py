"""Watching a folder: new media files once per content, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.functions import filetypes as T
from pixloom.functions import paths as P


def watch_media(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, name, sha256, true_ext, modified) of the media files that appear below root."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.where(T.is_media(P.base_name(F.col("path")))).select(
        path.alias("path"), P.base_name(path).alias("name"), F.sha2("content", 256).alias("sha256"), T.sniff_type(F.col("content")).alias("true_ext"), F.col("modificationTime").alias("modified")
    )


def first_of_content(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """The first row of each content. State is kept for `within` of modification time, so it does not grow without bound; a
    content that comes back later is given again, and the anti-join against what is done drops it."""
    return stream.withWatermark("modified", within).dropDuplicatesWithinWatermark(["sha256"])
