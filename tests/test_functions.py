"""Case tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from pixloom.functions import bits, dates, filetypes, paths, sidecar_names, tool_log

MIN, MAX = 1995, 2027


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_suffix_and_stem(spark):
    names = ["a.jpg", ".jpg", "a.", "a.tar.gz", "a", "IMG.jpg(1)", None, ""]
    assert column(spark, names, "string", paths.suffix) == [".jpg", "", "", ".gz", "", ".jpg(1)", None, ""]
    assert column(spark, names, "string", paths.stem) == ["a", ".jpg", "a.", "a.tar", "a", "IMG", None, ""]


def test_buckets_and_albums(spark):
    p = ["x/Trash/a.jpg", "x/ARCHIVE/a.jpg", "archive/trash/a.jpg", "x/Trashy/a.jpg", None]
    assert column(spark, p, "string", paths.path_bucket) == ["trash", "archive", "trash", None, None]
    p = ["r/Trip/a.jpg", "r/Photos from 2019/a.jpg", f"r/{paths.SKIPPED_FOLDERS[0]}/a.jpg", "a.jpg", "r/photos from 19/a.jpg"]
    assert column(spark, p, "string", paths.album_of) == ["Trip", None, None, None, "photos from 19"]
    assert column(spark, ['a<b>:c', " x. . ", "..."], "string", paths.safe_album) == ["a_b__c", "x", "_album"]


def test_human_size(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1048576, 5 * 1024**3, 5000 * 1024**3], "bigint", paths.human_size) == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "5000.0 GB"]


def test_errors_path(spark):
    rows = spark.createDataFrame(
        [("dir", "/in/{}/{}/A/x.jpg".format(*paths.SKIPPED_FOLDERS), None, None), ("zip", None, "/in/part-1.zip", f"{paths.SKIPPED_FOLDERS[0]}/A/x.jpg"), ("zip", None, "/in/box/p.zip", f"{paths.SKIPPED_FOLDERS[0]}/x.jpg")], "src string, path string, zip string, entry string"
    )
    got = [r.x for r in rows.select(paths.errors_path(F.col("src"), F.col("path"), F.col("zip"), F.col("entry"), "/in").alias("x")).collect()]
    assert got == ["A/x.jpg", "part-1/A/x.jpg", "box/x.jpg"]


PAD = b"\0" * 20


@pytest.mark.parametrize(
    "head,kind",
    [
        (b"\xff\xd8\xff\xe0" + PAD, "jpg"), (b"\x89PNG\r\n\x1a\n" + PAD, "png"), (b"GIF89a" + PAD, "gif"), (b"BM" + PAD, "bmp"), (b"RIFF\0\0\0\0WEBP" + PAD, "webp"), (b"RIFF\0\0\0\0AVI " + PAD, "avi"),
        (b"RIFF\0\0\0\0WAVE" + PAD, None), (b"\x1aE\xdf\xa3" + PAD, "mkv"), (b"\0\0\0\x18ftypisom" + PAD, "mp4"), (b"\0\0\0\x18ftypqt  " + PAD, "mov"), (b"\0\0\0\x18ftypM4V " + PAD, "m4v"),
        (b"\0\0\0\x18ftyp3gp4" + PAD, "3gp"), (b"\0\0\0\x18ftypmp42" + PAD, "mp4"), (b"\0\0\0\x18ftypheic" + PAD, "heic"), (b"\0\0\0\x18ftypavif" + PAD, "avif"), (b"\0\0\0\x18ftypMSNV" + PAD, None),
        (b"II*\0" + PAD, None), (b"MM\0*" + PAD, None), (b"plain text, no type" + PAD, None), (b"", None), (b"\xff\xd8", None), (None, None),
    ],
)
def test_sniff(spark, head, kind):
    assert column(spark, [head], "binary", filetypes.sniff_type) == [kind]


def test_corrected_names(spark):
    rows = spark.createDataFrame([("IMG.heic", "jpg"), ("IMG.jpeg", "jpg"), ("IMG.heif", "heic"), ("IMG.cr2", None), ("IMG.jpg", "jpg"), ("a.b.mov", "mp4")], "n string, t string")
    got = [r.x for r in rows.select(filetypes.corrected_name(F.col("n"), F.col("t")).alias("x")).collect()]
    assert got == ["IMG.jpg", "IMG.jpeg", "IMG.heif", "IMG.cr2", "IMG.jpg", "a.b.mp4"]
    assert column(spark, ["mp4", ".MOV", "jpg", "x"], "string", filetypes.media_kind) == ["videos", "videos", "photos", "photos"]


def test_plausible(spark):
    assert column(spark, [1483228800, 315525610, 2840140800, 0, None, -5], "bigint", lambda c: dates.plausible_ts(c, MIN, MAX)) == [True, False, False, False, False, False]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ('{"photoTakenTime": {"timestamp": "1483228800"}}', (2017, 1)), ('{"photoTakenTime": {"timestamp": "315525610"}, "creationTime": {"timestamp": "1717543804"}}', None),
        ('{"creationTime": {"timestamp": "1717543804"}}', (2024, 6)), ('{"photoTakenTime": null, "creationTime": {"timestamp": 1717543804}}', (2024, 6)), ("{}", None), ("[1]", None), ("{cut", None), (None, None),
        ('{"photoTakenTime": {"timestamp": "1483228800"', None), ('{"photoTakenTime": {"timestamp": "1_0"}}', None),
    ],
)
def test_sidecar_date(spark, raw, expected):
    got = column(spark, [raw], "string", lambda c: dates.sidecar_date(c, MIN, MAX))[0]
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("2017:01:15 12:30:00", (2017, 1)), ("2024:06:04", (2024, 6)), ("1980:01:01 00:00:00", None), ("0000:00:00 00:00:00", None), ("", None), ("garbage", None), ("2017:13:01", None), ("20170115", (2017, 11)), (None, None)],
)
def test_embedded_date(spark, text, expected):
    got = column(spark, [text], "string", lambda c: dates.embedded_date(c, MIN, MAX))[0]
    assert (got and tuple(got)) == expected


def test_inner_and_dest_names(spark):
    names = ["a.jpg.json", "a.jpg.supplemental-metadata.json", "a.jpg.suppl.json", "a.jpg.s.json", "a.jpg..json", "a.jpg.JSON", "a.jpg.supplemental-metadata(3).json"]
    assert column(spark, names, "string", sidecar_names.inner_name) == ["a.jpg", "a.jpg", "a.jpg", "a.jpg", "a.jpg", None, "a.jpg.supplemental-metadata(3)"]
    rows = spark.createDataFrame([("a.jpg", "a.jpg.supplemental-metadata.json"), ("a.jpg", "a.jpg.suppl.json")], "m string, o string")
    assert [r.x for r in rows.select(sidecar_names.sidecar_dest(F.col("m"), F.col("o")).alias("x")).collect()] == ["a.jpg.supplemental-metadata.json", "a.jpg.json"]


def test_bits(one):
    assert one(bits.hamming(F.col("a"), F.col("b")), "a array<bigint>, b array<bigint>", [0, 255, -1], [1, 0, 0]) == 1 + 8 + 64
    assert one(bits.color_distance(F.col("a"), F.col("b")), "a array<int>, b array<int>", [0, 0, 0, 9], [255, 255, 255]) == 765
    assert one(bits.difference_hash(F.col("a"), 3, 4), "a array<float>", [10.0, 20.0, 30.0, 30.0, 20.0, 10.0]) == 0b0011


def test_tool_lines(spark):
    lines = ["Warning: [minor] x", "Error: Bad GPS", "Warning: Maker Notes", "Error: x not yet supported", "Warning: bad IFD0", "Error: other", "Warning: other"]
    assert column(spark, lines, "string", tool_log.warning_category) == [None, "GPS unreadable", "maker notes unparsed", "unsupported file type (left as-is)", "corrupt EXIF structure", "other errors", "other warnings"]
    lines = ["======== a.jpg [1/20]", "  ", "Error opening file x", "  12 image files updated", "Warning: x", "hello"]
    assert column(spark, lines, "string", tool_log.line_class) == ["progress", "noise", "noise", "summary", "warning", "other"]
