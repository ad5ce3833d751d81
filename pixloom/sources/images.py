"""Perceptual fingerprints of pictures: decoded by the JVM's image reader, reduced in Arrow batches.

The resize averages areas. It does the same job as other resize filters but not bit for bit, so fingerprints are comparable with
each other only. Types that the JVM cannot decode (HEIC, AVIF, raw) give no fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, TILES = 16, 4


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages of a height x width grid; each cell covers at least one pixel."""
    rows = np.linspace(0, pixels.shape[0], height + 1)
    cols = np.linspace(0, pixels.shape[1], width + 1)
    out = np.empty((height, width, *pixels.shape[2:]))
    for i in range(height):
        band = pixels[int(rows[i]) : max(int(np.ceil(rows[i + 1])), int(rows[i]) + 1)]
        for j in range(width):
            out[i, j] = band[:, int(cols[j]) : max(int(np.ceil(cols[j + 1])), int(cols[j]) + 1)].mean(axis=(0, 1))
    return out


def fingerprint(pixels: np.ndarray) -> tuple[list[int], list[int]]:
    """(4 signed 64-bit words, 48 color values) of height x width x RGB pixels."""
    gray = np.rint(pixels @ np.array([0.299, 0.587, 0.114]))
    small = np.rint(resize(gray, SIDE, SIDE + 1))
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    words = np.packbits(bits).view(">u8").astype(np.uint64).view(np.int64)
    return words.tolist(), np.rint(resize(pixels, TILES, TILES)).astype(int).reshape(-1).tolist()


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(path, words ARRAY<BIGINT>, color ARRAY<INT>, w, h) of the pictures below root that can be decoded."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    flat = images.select(F.try_url_decode(F.regexp_replace(F.replace("image.origin", F.lit("+"), F.lit("%2B")), "^file:/*", "/")).alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, h, w, channels, data in batch.itertuples(index=False):
                raw = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels).astype(float)
                rgb = raw[:, :, 2::-1] if channels >= 3 else np.repeat(raw[:, :, :1], 3, axis=2)
                rows.append((path, *fingerprint(rgb), w, h))
            yield pd.DataFrame(rows, columns=["path", "words", "color", "w", "h"])

    return flat.mapInPandas(reduce, "path string, words array<bigint>, color array<int>, w int, h int")
