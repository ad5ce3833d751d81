"""Media types by extension and by signature, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixloom.functions.paths import stem, suffix

# Extensions by kind, interchangeable extensions, and signatures.
PHOTO = ["jpg", "jpeg", "png", "gif", "heic", "heif", "avif", "bmp", "tiff", "tif", "webp", "cr2", "nef", "arw", "dng", "orf", "rw2"]
VIDEO = ["mp4", "mov", "avi", "mkv", "m4v", "3gp", "wmv"]
SAME = {"jpg": ("jpg", "jpeg", "jpe"), "tif": ("tif", "tiff"), "heic": ("heic", "heif")}
HEIC_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx", "mif1", "msf1"]
AVIF_BRANDS = ["avif", "avis"]
MP4_BRANDS = ["isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "mp4 ", "mp4v", "avc1", "dash", "msnv", "ndsc", "f4v ", "cmff"]
ASF_GUID = "3026B2758E66CF11A6D900AA0062CE6C"
HEAD_BYTES = 32


def canon_ext(ext: Column) -> Column:
    """Lower case, without leading dots, one representative of interchangeable extensions."""
    e = F.regexp_replace(F.lower(ext), r"^\.+", "")
    out = e
    for one, group in SAME.items():
        out = F.when(e.isin(*group), one).otherwise(out)
    return out


def media_kind(ext: Column) -> Column:
    """videos or photos."""
    return F.when(canon_ext(ext).isin(*VIDEO), "videos").otherwise("photos")


def is_media(name: Column) -> Column:
    return F.lower(suffix(name)).isin(*[f".{e}" for e in PHOTO + VIDEO])


def sniff_type(head: Column) -> Column:
    """The type that a file's first bytes show, null if unsure: fewer than 12 bytes, TIFF and raw formats, unknown brands."""
    hexed = F.hex(F.substring(head, 1, HEAD_BYTES))
    at = lambda first, n: F.substring(hexed, 2 * first + 1, 2 * n)
    code = lambda text: text.encode().hex().upper()
    brand = at(8, 4)
    low = F.lower(F.rtrim(F.decode(F.unhex(brand), "ISO-8859-1")))
    iso = (
        F.when(brand.isin(*map(code, HEIC_BRANDS)), "heic")
        .when(brand.isin(*map(code, AVIF_BRANDS)), "avif")
        .when(brand == code("qt  "), "mov")
        .when(low.startswith("m4v"), "m4v")
        .when(low.startswith("3g"), "3gp")
        .when(brand.isin(*map(code, MP4_BRANDS)), "mp4")
    )
    return F.when(
        F.length(hexed) >= 24,
        F.when(at(0, 3) == "FFD8FF", "jpg")
        .when(at(0, 8) == "89504E470D0A1A0A", "png")
        .when(at(0, 6).isin(code("GIF87a"), code("GIF89a")), "gif")
        .when(at(0, 2) == code("BM"), "bmp")
        .when(at(0, 4) == "1A45DFA3", "mkv")
        .when(at(0, 16) == ASF_GUID, "wmv")
        .when(at(0, 4) == code("RIFF"), F.when(brand == code("WEBP"), "webp").when(brand == code("AVI "), "avi"))
        .when(at(4, 4) == code("ftyp"), iso),
    )


def corrected_name(name: Column, true_ext: Column) -> Column:
    """The name with the extension its content asks for; unchanged if that is unknown or interchangeable with its own."""
    keep = true_ext.isNull() | (true_ext == "") | (canon_ext(suffix(name)) == canon_ext(true_ext))
    return F.when(keep, name).otherwise(F.concat(stem(name), F.lit("."), true_ext))
