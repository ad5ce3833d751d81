"""Orphan sidecars: the ways their names and places are altered, and what must not match."""

from pixloom.llm.entities import fold, match_orphans, with_name_parts, with_place_parts

COPIES = "scan_ord bigint, sha256 string, src string, path string, zip string, entry string, name string, sidecar struct<kind:string,path:string,zip:string,entry:string>, hash string"
ORPHANS = "scan_ord bigint, inner_name string, ref struct<kind:string,path:string,zip:string,entry:string>"
DOCS = "sidecar_id bigint, ref struct<kind:string,path:string,zip:string,entry:string>, raw string"
EXIF = "rec_id bigint, source_file string, datetimeoriginal string, createdate string, offsettimeoriginal string, offsettimedigitized string, tz string"


def test_names(spark):
    names = ["IMG_1.JPG", "IMG_1(2).jpg", "348 - IMG_1.jpg", "(190) IMG_1.jpg", "IMG_1-EFFECTS-edited.jpg", "IMG%5F1_web.jpg", "Café 7.png", "Café_7 - Kopie.png", "IMG_1~3(1).jpg", "copy.jpg", "100% x.jpg"]
    df = with_name_parts(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"), fold.__globals__["F"].col("name")).orderBy("i").collect()
    assert [(r.core, r.cnt, r.edit) for r in df] == [
        ("img 1", "", ""), ("img 1", "2", ""), ("img 1", "", ""), ("img 1", "", ""), ("img 1", "", "-effects-edited"), ("img 1", "", "web"), ("cafe 7", "", ""), ("cafe 7", "", "- kopie"), ("img 1", "1", "~3"), ("copy", "", ""), ("100% x", "", ""),
    ]
    places = ["/srv/in/lib1/Export/Photos/Trip 2019(1)/a.jpg", "/srv/in/lib1/p.zip::Export/Photos/Trip_2019/a.jpg", "/srv/in/loose/Trip 2019/123/a.json"]
    got = with_place_parts(spark.createDataFrame([(p,) for p in places], "p string"), fold.__globals__["F"].col("p")).collect()
    assert [(r.lib, r.folder) for r in got] == [("/srv/in/lib1", "trip2019"), ("/srv/in/lib1", "trip2019"), ("/srv/in/loose", "trip2019")]


BASE = "/srv/in/{}/Photos/{}/{}"


class World:
    def __init__(self):
        self.copies, self.orphans, self.docs, self.exif = [], [], [], []

    def media(self, h, lib, folder, name, taken=None, off=None, sidecar=None):
        path = BASE.format(lib, folder, name)
        self.copies.append((len(self.copies), f"{h:064X}" if h % 2 else f"{h:064x}", "dir", path, None, None, name, ("dir", sidecar, None, None) if sidecar else None, "x"))
        if taken:
            self.exif.append((len(self.exif), path, taken, None, off, None, None))

    def doc(self, path, title=None, ts=None):
        raw = "{" + ", ".join(([f'"title": "{title}"'] if title else []) + ([f'"photoTakenTime": {{"timestamp": "{ts}"}}'] if ts else [])) + "}"
        self.docs.append((len(self.docs), ("dir", path, None, None), raw))

    def orphan(self, o, lib, folder, inner, title=None, ts=None, json=None):
        path = BASE.format(lib, folder, json or f"{inner}.json")
        self.orphans.append((o, inner, ("dir", path, None, None)))
        self.doc(path, title or inner, ts)

    def run(self, spark):
        make = lambda rows, schema: spark.createDataFrame(rows, schema)
        return match_orphans(make(self.copies, COPIES), make(self.orphans, ORPHANS), make(self.docs, DOCS), make(self.exif, EXIF))


TS = 1593598830  # 2020-07-01 10:20:30 UTC


def test_cases(spark):
    w = World()
    w.media(1, "lib1", "Trip 2019", "IMG_1.jpg", "2020:07:01 12:20:30", "+02:00")
    w.orphan(1, "lib1", "Trip_2019", "IMG_1.jpg", ts=TS)  # folder spelled otherwise
    w.orphan(2, "lib1", "Trip 2019(1)", "IM_1.jpg", title="IMG_1.jpg", ts=TS)  # delivered twice, once with a damaged name
    w.orphan(3, "lib1", "Photos from 2015", "IMG_1.jpg", ts=TS - 10**8)  # another photograph of the same name
    w.orphan(4, "lib2", "Trip 2019", "IMG_1.jpg", ts=TS - 10**7)  # another library
    w.media(2, "lib1", "Trip 2019", "IMG_1-edited.jpg")  # edited copy of it, without tags
    w.media(3, "lib1", "Trip 2019", "IMG_1(1).jpg")  # another photograph, counted
    w.orphan(5, "lib1", "Trip 2019", "IMG_1.jpg(1)", title="IMG_1.jpg", ts=TS + 5000)
    w.media(4, "lib1", "Trip 2019", "Picnic 7.jpg", "2020:07:05 10:00:00", "Z")  # renamed
    w.orphan(6, "lib1", "Trip 2019", "PXL_5.jpg", ts=1593943200)
    w.media(5, "lib3", "Album", "IMG_9.jpg", "2020:07:01 10:20:30", "Z")
    w.orphan(7, "loose", "Album/4711", "IMG_9.jpg", ts=TS)  # library unknown
    w.media(6, "lib3", "Album", "IMG_8.jpg", sidecar=BASE.format("lib3", "Album", "IMG_8.jpg.json"))
    w.doc(BASE.format("lib3", "Album", "IMG_8.jpg.json"), "IMG_8.jpg", TS)
    w.orphan(8, "lib3", "Album", "IMG_8.jpg.supplemental-metadata", title="IMG_8.jpg", ts=TS)  # that content has a sidecar
    w.media(7, "lib3", "Album", "web_only-COLLAGE.jpg", "2020:07:09 10:00:00", "Z")
    w.orphan(9, "lib3", "Album", "web_only.jpg", ts=1594288800)
    w.orphan(10, "lib3", "Album", "nobody.jpg", ts=TS + 99)
    w.orphan(11, "lib1", "Trip 2019", "IMG_1-COLLAGE.jpg", ts=TS)  # of an edited copy, not of the original
    w.copies += [(900, None, "dir", "/srv/in/lib1/x.jpg", None, None, "x.jpg", None, "x"), (901, "zz", "dir", "/x.jpg", None, None, "x.jpg", None, "x"), w.copies[0]]
    w.orphans += [(None, "x.jpg", ("dir", BASE.format("lib1", "Trip 2019", "IMG_1.jpg.json"), None, None)), (90, None, None), (91, "x.jpg", ("dir", None, None, None)), w.orphans[0]]
    w.docs += [(900, None, None), (901, ("dir", "/q.json", None, None), "{cut")]
    rows = w.run(spark).collect()
    got = {(int(r.hash, 16), r.orphan_ord) for r in rows}
    assert len(rows) == len(got)
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 5), (4, 6), (5, 7), (7, 9)}
    assert all(0 < r.confidence < 1 and r.rule for r in rows)


def test_confidence_is_judged_on_known_sidecars(spark):
    w = World()
    for i in range(40):  # known sidecars; of ten, another photograph of the same folder has the same second
        name, ts = f"IMG_{100 + i}.jpg", TS + 60 * i
        path = BASE.format("lib1", "Trip 2019", f"{name}.json")
        w.media(10 + i, "lib1", "Trip 2019", name, f"2020:07:01 {10 + (20 + i) // 60:02d}:{(20 + i) % 60:02d}:30", "Z", sidecar=path)
        w.doc(path, name, ts)
    for i in range(10):
        path = BASE.format("lib1", "Trip 2019", f"burst_{i}.jpg.json")
        w.media(60 + i, "lib1", "Trip 2019", f"burst_{i}.jpg", sidecar=path)
        w.doc(path, f"burst_{i}.jpg", TS + 60 * i)
    w.media(2, "lib1", "Trip 2019", "IMG_900.jpg", "2020:07:02 10:20:30", "Z")
    w.orphan(1, "lib1", "Trip 2019", "IMG_900.jpg", ts=TS + 86_400)
    w.media(3, "lib1", "Trip 2019", "Lake 4.jpg", "2020:07:03 10:20:31", "Z")  # renamed, and a second off
    w.orphan(2, "lib1", "Trip 2019", "PXL_7.jpg", ts=TS + 2 * 86_400 + 1)
    w.media(4, "lib4", "Trip 2019", "IMG_901.jpg", "2020:07:04 10:15:00", "Z")  # another library, and a second off across a quarter hour
    w.orphan(3, "lib5", "Trip 2019", "IMG_901.jpg", ts=TS + 3 * 86_400 - 331)
    got = {(int(r.hash, 16), r.orphan_ord): (r.rule, r.judged, round(r.confidence, 3)) for r in w.run(spark).collect()}
    assert got[2, 1] == ("name, folder and time", 40, round(41 / 42, 3))
    assert got[3, 2] == ("renamed: folder and time", 50, round(41 / 52, 3))  # with names hidden ten of fifty would be another's
    assert got[4, 3][0] == "name, folder and time, library unknown"


def test_empty(spark):
    assert World().run(spark).count() == 0
