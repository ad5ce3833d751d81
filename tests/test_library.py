"""Winners, motion, placement, near-duplicates, checks, and a tree from end to end."""

import io
import json
import os
import random
import struct
import zipfile

from pyspark.sql import functions as F

from pixloom.operators import motion, neardup, placement, review, verify, winners
from pixloom.operators.components import components
from pixloom.operators.dedup import keep_first


def sequential(rows):
    taken, out = {}, {}
    for ord_, folder, name in sorted(rows):
        used = taken.setdefault(folder, set())
        at = name.rfind(".")
        stem, ext = (name[:at], name[at:]) if 0 < at < len(name) - 1 else (name, "")
        pick, k = name, 1
        while pick in used:
            pick, k = f"{stem}_{k}{ext}", k + 1
        used.add(pick)
        out[ord_] = pick
    return out


def test_collision_numbers_are_sequential(spark):
    r = random.Random(1)
    names = ["a.jpg", "a_1.jpg", "a_1_1.jpg", "a_2.jpg", "a_3_1.jpg", "IMG_1.jpg", "IMG_2.jpg", "b", "b_1", "c.tar.gz", "c.tar_1.gz", ".x"]
    rows = [(i, f"f{r.randrange(4)}", r.choice(names)) for i in range(300)] + [(1000 + i, "hot", "a.jpg") for i in range(200)] + [(2000 + i, "none", f"IMG_{i}.jpg") for i in range(50)]
    df = spark.createDataFrame(rows, "scan_ord int, folder string, name string")
    got = {x.scan_ord: x.final_name for x in placement.number_names(df.repartition(3), ["scan_ord"]).collect()}
    assert got == sequential(rows)


def test_keep_first_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 3, "y"), (None, 1, None)], "k string, o int, v string")
    assert sorted((r.k or "", r.o, r.v, r.n_copies) for r in keep_first(df, ["k"], ["o"]).collect()) == [("", 1, None, 2), ("a", 1, "x", 2)]


def test_buckets(spark):
    rows = [("n", None), ("n", "archive"), ("a", "archive"), ("a", "trash"), ("t", "trash"), ("o", None)]
    got = spark.createDataFrame(rows, "h string, b string").groupBy("h").agg(winners.content_bucket(F.col("b")).alias("x")).collect()
    assert {r.h: r.x for r in got} == {"n": None, "a": "archive", "t": "trash", "o": None}


def test_motion(spark):
    rows = [("IMG.jpg", None), ("IMG.mp4", 2.0), ("IMG.MOV", 30.0), ("X.mp4", 2.0), ("IMG.avi", None), ("img.mp4", 1.0)]
    got = motion.is_motion(spark.createDataFrame(rows, "name string, duration double")).where("motion").collect()
    assert [r.name for r in got] == ["IMG.mp4"]


def prints(spark, rows):
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return spark.createDataFrame([(i, [signed((h >> (64 * (3 - w))) & (2**64 - 1)) for w in range(4)], c) for i, h, c in rows], "id int, words array<bigint>, color array<int>")


def test_banded_pairs_are_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(256) for _ in range(12)]
    hashes = [b ^ sum(1 << r.randrange(256) for _ in range(r.randrange(14))) for b in base for _ in range(8)] + [0] * 30
    rows = [(i, h, [r.randrange(3)] * 48) for i, h in enumerate(hashes)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bin(a[1] ^ b[1]).count("1") <= 20 and sum(abs(x - y) for x, y in zip(a[2], b[2])) <= 60}
    group = {i: i for i, _, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    linked = {i for p in want for i in p}
    got = {x.id: x.group_id for x in neardup.similar_groups(prints(spark, rows), 20, 60).collect()}
    assert got == {i: root(i) for i in linked}
    pairs = {(x.left_id, x.right_id) for x in neardup.similar_pairs(prints(spark, rows), 20, 60).collect()}
    assert pairs <= want
    assert len({frozenset((rows[a][1], rows[b][1])) for a, b in want if rows[a][1] != rows[b][1]}) <= len(pairs)


def test_chain_and_color_gate(spark):
    chain = prints(spark, [(0, 0, []), (1, 1, []), (2, 3, [])])
    assert {x.id: x.group_id for x in neardup.similar_groups(chain, 1, None).collect()} == {0: 0, 1: 0, 2: 0}
    blue, green = [0, 0, 255] * 16, [0, 255, 0] * 16
    assert {x.id for x in neardup.similar_groups(prints(spark, [(0, 9, blue), (1, 9, blue), (2, 9, green)]), 1, 100).collect()} == {0, 1}


def test_flat_pictures_meet_by_color(spark):
    r = random.Random(12)
    rows = [(i, 0, [r.randrange(256)] * 48) for i in range(300)] + [(500, 1 << 7, [3] * 48), (501, 1 << 7, [4] * 48), (502, 0, None), (503, 0, None)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] and b[2] and sum(abs(x - y) for x, y in zip(a[2], b[2])) <= 100} | {(502, 503)}
    got = {(x.left_id, x.right_id) for x in neardup.similar_pairs(prints(spark, rows), 2, 100).collect()}
    first = {}
    for i, h, c in rows:
        first.setdefault((h, tuple(c or ())), i)
    reps = {(first[a[1], tuple(a[2] or ())], first[b[1], tuple(b[2] or ())]) for a in rows for b in rows if (min(a[0], b[0]), max(a[0], b[0])) in want}
    assert got <= want and {(min(p), max(p)) for p in reps if p[0] != p[1]} <= got
    assert neardup.similar_groups(prints(spark, rows), 2, None).select("group_id").distinct().count() == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(700)] + [(5, 5), (None, 3), (900, 901), (901, 900)], "a int, b int")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(701)} | {900: 900, 901: 900}


def test_review(spark):
    groups = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", None), (2, "x", 1), (2, "y", 2)], "group_id int, path string, size int")
    assert {r.path for r in review.registry(groups).where("suggest_keep").collect()} == {"a", "y"}
    there = spark.createDataFrame([("a",), ("b",), ("x",)], "path string")
    assert {r.path for r in review.present_groups(groups, there).collect()} == {"a", "b"}


def test_verdicts(spark):
    hashes = spark.createDataFrame([("AA",), ("bb",), (None,)], "sha256 string")
    files = spark.createDataFrame([("photos/2020/01/a.jpg",), ("photos/unknown/b.jpg",), ("notes.txt",)], "rel_path string")
    good = verify.count_checks(hashes, hashes, files).unionByName(verify.undated_check(files))
    assert tuple(verify.verdict(good).first()) == (True, 0)
    bad = verify.count_checks(hashes, hashes, files.limit(1))
    assert tuple(verify.verdict(bad).first()) == (False, 1)


def jpeg(tag, date=None):
    exif = b""
    if date:
        text = date.encode() + b"\0"
        ifd = struct.pack("<HHHIIHI", 1, 0x9003, 2, len(text), 44, 0, 0)[:14]
        sub = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(text), 44) + struct.pack("<I", 0)
        tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0) + sub + text
        body = b"Exif\0\0" + tiff
        exif = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
        del ifd
    return b"\xff\xd8" + exif + b"\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + tag.encode() + b"\xff\xd9"


def movie(seconds, made):
    mvhd = struct.pack(">I4sIIIII", 28, b"mvhd", 0, made + 2_082_844_800, 0, 1000, int(seconds * 1000))
    return struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8 + len(mvhd), b"moov") + mvhd


def sidecar(ts):
    return json.dumps({"photoTakenTime": {"timestamp": str(ts)}})


def test_tree_end_to_end(spark, tmp_path):
    from pixloom.plans.pipeline import run

    src, out = tmp_path / "in", tmp_path / "out"
    album = src / "AlbumA"
    album.mkdir(parents=True)
    for d in ("Trash", "Archive"):
        (src / d).mkdir()
    put = lambda p, b: p.write_bytes(b if isinstance(b, bytes) else b.encode())
    put(album / "PIC1.jpg", jpeg("one"))
    put(album / "PIC1.jpg.supplemental-metadata.json", sidecar(1483228800))
    put(album / "PIC2.heic", jpeg("two"))
    put(album / "PIC2.heic.suppl.json", sidecar(1717543804))
    put(album / "BOGUS.jpg", jpeg("bogus"))
    put(album / "BOGUS.jpg.json", sidecar(315525610))
    put(album / "SPLIT.jpg", jpeg("split"))
    put(album / "EMB.jpg", jpeg("emb", "2019:05:02 10:00:00"))
    put(album / "NOTHING.jpg", jpeg("nothing"))
    put(album / "LIVE.jpg", jpeg("live", "2018:03:02 10:00:00"))
    put(album / "LIVE.mp4", movie(2, 1_600_000_000))
    put(album / "CLIP.mp4", movie(30, 1_600_000_000))
    put(src / "Trash" / "T.jpg", jpeg("t", "2020:01:01 00:00:00"))
    put(src / "Archive" / "A.jpg", jpeg("a", "2020:01:01 00:00:00"))
    with zipfile.ZipFile(src / "part.zip", "w") as z:
        z.writestr("Export/AlbumB/PIC1.jpg", jpeg("one"))
        z.writestr("Export/AlbumB/SPLIT.jpg.json", sidecar(1546300800))
    put(src / "broken.zip", b"no archive")
    before = {p: p.stat().st_mtime_ns for p in src.rglob("*")}
    done = run(spark, str(src), str(out))
    plan = {r.out_name: (r.outcome, r.folder) for r in done["plan"].collect()}
    assert plan == {
        "PIC1.jpg": ("placed", "final/photos/2017/01"),
        "PIC2.jpg": ("placed", "final/photos/2024/06"),
        "BOGUS.jpg": ("placed", "final/photos/unknown"),
        "SPLIT.jpg": ("placed", "final/photos/2019/01"),
        "EMB.jpg": ("placed", "final/photos/2019/05"),
        "NOTHING.jpg": ("errored", "errors/AlbumA"),
        "LIVE.jpg": ("placed", "final/photos/2018/03"),
        "LIVE.mp4": ("motion", "motion"),
        "CLIP.mp4": ("placed", "final/videos/2020/09"),
        "T.jpg": ("trashed", "Trash/photos/2020/01"),
        "A.jpg": ("archived", "Archive/photos/2020/01"),
    }
    assert done["summary"].first().asDict() == {"files": 12, "unique": 11, "redundant": 1, "with_sidecar": 4, "recovered": 1, "without_sidecar": 7}
    assert done["verdict"].first().safe
    assert (out / "final/photos/2019/01/SPLIT.jpg").read_bytes() == jpeg("split")
    assert {r.album for r in done["albums"].collect()} == {"AlbumA", "AlbumB"}
    assert {(r.category, r.ident) for r in done["errors"].collect()} == {("read_error", str(src / "broken.zip")), ("missing_sidecar", str(album / "NOTHING.jpg"))}
    assert (out / "errors/AlbumA/NOTHING.jpg").read_bytes() == jpeg("nothing")
    # sidecars beside their media, under the file's name there
    assert (out / "final/photos/2017/01/PIC1.jpg.supplemental-metadata.json").read_text() == sidecar(1483228800)
    assert sorted(p.relative_to(out).as_posix() for p in out.glob("final/**/*.json")) == [
        "final/photos/2017/01/PIC1.jpg.supplemental-metadata.json", "final/photos/2019/01/SPLIT.jpg.json", "final/photos/2024/06/PIC2.jpg.json", "final/photos/unknown/BOGUS.jpg.json",
    ]
    assert before == {p: p.stat().st_mtime_ns for p in src.rglob("*")}
    again = run(spark, str(src), str(out))  # running twice changes nothing
    assert {r.outcome for r in again["effects"].collect()} == {"present"} and {r.outcome for r in again["album_effects"].collect()} == {"present"}
    assert sum(n.rsplit(".")[-1] in ("jpg", "mp4", "heic") for d, _, f in os.walk(out) if "Albums" not in d for n in f) == 11
    assert sorted(p.relative_to(out).as_posix() for p in out.glob("Albums/*/*")) == [f"Albums/AlbumA/{n}" for n in ("BOGUS.jpg", "CLIP.mp4", "EMB.jpg", "LIVE.jpg", "PIC1.jpg", "PIC2.jpg", "SPLIT.jpg")] + ["Albums/AlbumB/PIC1.jpg"]


def test_fingerprints(spark, tmp_path):
    import numpy as np

    from pixloom.sources.images import fingerprint

    a = np.zeros((64, 64, 3))
    a[:, :32] = 255
    noisy = np.clip(a + np.random.default_rng(0).normal(0, 3, a.shape), 0, 255)
    other = a.transpose(1, 0, 2)
    near, far = fingerprint(a), fingerprint(noisy)
    assert len(near[0]) == 4 and len(near[1]) == 48
    assert sum(abs(x - y) for x, y in zip(near[1], far[1])) < 100 < sum(abs(x - y) for x, y in zip(near[1], fingerprint(other)[1]))


def test_zip_ranges(spark, tmp_path):
    from pixloom.sources.files import zip_entries

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i in range(25):
            z.writestr(f"d/{i}.jpg", jpeg(str(i)))
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    df = zip_entries(spark.createDataFrame([(str(tmp_path / n),) for n in ("a.zip", "broken.zip")], "path string"), entries_per_task=10)
    assert df.rdd.getNumPartitions() == 4 and df.where("error is null").select("sha256").distinct().count() == 25 and df.where("error is not null").count() == 1
    assert zip_entries(df.select(F.col("zip").alias("path")).limit(0)).count() == 0


def test_stream(spark, tmp_path):
    from pixloom.streaming.ingest import first_of_content, watch_media

    (tmp_path / "in").mkdir()
    for n in ("a.jpg", "b.jpg"):
        (tmp_path / "in" / n).write_bytes(jpeg("same"))
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    q = first_of_content(watch_media(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 1
