"""Album folders rebuilt from placed contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions import paths as P
from pixloom.operators.placement import number_names


def album_names(placed: DataFrame, root: str, folder: str = "Albums") -> DataFrame:
    """placed(sha256, rel_path, albums) -> (album, sha256, source, folder, name): each content in each of its albums, names as they are."""
    rows = placed.select("sha256", "rel_path", F.explode("albums").alias("album"))
    return rows.select("album", "sha256", F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("source"), F.concat_ws("/", F.lit(folder), P.safe_album(F.col("album"))).alias("folder"), P.base_name(F.col("rel_path")).alias("name"))


def album_links(placed: DataFrame, root: str, folder: str = "Albums") -> DataFrame:
    """placed(sha256, rel_path, albums) -> (album, sha256, source, rel_path): the link of each content in each of its albums.

    Names in an album are made distinct in the order of their content's hash, so the same library always gives the same links
    and running again adds none. Contents without albums give no rows.
    """
    return number_names(album_names(placed, root, folder), ["sha256"]).select("album", "sha256", "source", F.concat_ws("/", "folder", "final_name").alias("rel_path"))
