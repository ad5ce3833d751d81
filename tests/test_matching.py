"""Sidecar matching: its single cases, written out. The queries over the test tables are compared with SQL in test_entry."""

import pytest
from pyspark.sql import functions as F

from pixloom.operators.matching import choose_sidecar, match_anywhere, match_in_folder, orphan_sidecars

CUT = "B" * 46  # names of this length are cut by exports

# a media name, the .json files of its folder, and the one that belongs to it
FOLDERS = [
    ("plain", "a.jpg", ["a.jpg.json", "b.jpg.json"], "a.jpg.json"),
    ("long ending", "a.jpg", ["a.jpg.supplemental-metadata.json"], "a.jpg.supplemental-metadata.json"),
    ("cut ending", "a.jpg", ["a.jpg.supplemen.json"], "a.jpg.supplemen.json"),
    ("ending cut to its dot", "a.jpg", ["a.jpg..json"], "a.jpg..json"),
    ("longest ending first", "a.jpg", ["a.jpg.json", "a.jpg.suppl.json", "a.jpg.supplemental-metadata.json"], "a.jpg.supplemental-metadata.json"),
    ("counter moved behind the extension", "a(1).jpg", ["a.jpg(1).json"], "a.jpg(1).json"),
    ("counter behind the ending", "a(2).jpg", ["a.jpg.supplemental-metadata(2).json"], "a.jpg.supplemental-metadata(2).json"),
    ("counter before the ending", "a(2).jpg", ["a.jpg(2).supplemental-metadata.json"], "a.jpg(2).supplemental-metadata.json"),
    ("counter where it was comes first", "a(1).jpg", ["a.jpg(1).json", "a(1).jpg.json"], "a(1).jpg.json"),
    ("another counter is another file", "a(1).jpg", ["a.jpg.json", "a.jpg(2).json"], None),
    ("letter case of names counts", "A.jpg", ["a.jpg.json"], None),
    ("letter case of the extension counts for plain names", "a.JPG", ["a.jpg.json"], None),
    ("cut name", CUT + "_more.jpg", [CUT + ".jpg.json"], CUT + ".jpg.json"),
    ("cut name, extension in any letter case", CUT + "_more.JPG", [CUT + ".jpg.json"], CUT + ".jpg.json"),
    ("longest cut name", CUT + "_more.jpg", [CUT[:40] + ".jpg.json", CUT + ".jpg.json"], CUT + ".jpg.json"),
    ("30 letters are enough", "C" * 33 + ".jpg", ["C" * 30 + ".jpg.json"], "C" * 30 + ".jpg.json"),
    ("29 letters are not", "C" * 33 + ".jpg", ["C" * 29 + ".jpg.json"], None),
    ("cut name of another type", CUT + "_more.jpg", [CUT + ".mp4.json"], None),
    ("edited copy", "a-edited.jpg", ["a.jpg.json"], "a.jpg.json"),
    ("edited copy, extension in lower case", "a-edited.JPG", ["a.jpg.json"], "a.jpg.json"),
    ("edited copy with its own", "a-edited.jpg", ["a.jpg.json", "a-edited.jpg.json"], "a-edited.jpg.json"),
    ("cut name before the original's", CUT + "-edited.jpg", [CUT + ".jpg.supplemental-metadata.json", CUT + "-edi.jpg.json"], CUT + "-edi.jpg.json"),
    ("the mark elsewhere says nothing", "a-edited-b.jpg", ["a.jpg.json"], None),
    ("without extension", "a", ["a.json", "a.jpg.json"], "a.json"),
    ("no .json", "a.jpg", ["a.jpg.JSON", "a.jpg.txt"], None),
]


@pytest.fixture(scope="module")
def matched(spark):
    media = [(what, name) for what, name, _, _ in FOLDERS]
    sidecars = [(what, j) for what, _, jsons, _ in FOLDERS for j in jsons]
    rows = match_in_folder(spark.createDataFrame(media * 2, "folder string, name string"), spark.createDataFrame(sidecars * 2, "folder string, json string")).collect()
    assert len(rows) == len({(r.folder, r.name) for r in rows})
    return {r.folder: r.sidecar for r in rows}


@pytest.mark.parametrize("what,expected", [(what, want) for what, _, _, want in FOLDERS])
def test_folder(matched, what, expected):
    assert matched.get(what) == expected


def test_orphans(spark):
    media = spark.createDataFrame([("d", "a.jpg"), ("d", None), (None, "x.jpg")], "folder string, name string")
    side = spark.createDataFrame([("d", "a.jpg.json"), ("d", "b.jpg.suppl.json"), ("e", "a.jpg.json"), ("d", ".json")], "folder string, json string")
    assert sorted(map(tuple, orphan_sidecars(media, side).collect())) == [("d", "b.jpg.suppl.json", "b.jpg"), ("e", "a.jpg.json", "a.jpg")]


def test_anywhere_order(spark):
    names = ["ORPH.jpg", "IMG(1).jpg", "Y" * 40 + ".JPG", "p-edited-edited.jpg", "q-edited.JPG", "none.jpg", None]
    keys = ["ORPH.jpg", "IMG.jpg(1)", "Y" * 37 + ".jpg", "Y" * 31 + ".jpg", "p.jpg", "q.jpg", None]
    got = match_anywhere(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "inner_name string"))
    assert {(r.name, r.inner) for r in got.collect()} == {("ORPH.jpg", "ORPH.jpg"), ("IMG(1).jpg", "IMG.jpg(1)"), ("Y" * 40 + ".JPG", "Y" * 37 + ".jpg"), ("p-edited-edited.jpg", "p.jpg")}


def test_choice(spark):
    refs = spark.createDataFrame([("a", "/x/1.json"), ("a", "/w/2.json"), ("b", "/x/3.json"), ("c", "/b/z.json"), ("c", "/a/z.json")], "k string, ref_id string")
    docs = spark.createDataFrame([("/w/2.json", '{"photoTakenTime": {"timestamp": "1483228800"}}'), ("/x/1.json", "{}"), ("/x/3.json", None)], "ref_id string, raw string")
    assert sorted(map(tuple, choose_sidecar(refs, docs, ["k"]).collect())) == [("a", "/w/2.json"), ("b", "/x/3.json"), ("c", "/a/z.json")]


def test_empty(spark):
    none = spark.createDataFrame([], "folder string, name string")
    assert match_in_folder(none, none.withColumnRenamed("name", "json")).count() == 0
    assert match_anywhere(none, none.select(F.col("name").alias("inner_name"))).count() == 0
