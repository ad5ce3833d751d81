"""The pipeline from a tree to a library: where dates come from, and what is there already."""

import zipfile

from test_library import jpeg, movie, sidecar

from pixloom.plans.pipeline import run


def test_dates_are_read_wherever_the_sidecar_has_none(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "A").mkdir(parents=True)
    (src / "A" / "NULL.jpg").write_bytes(jpeg("null", "2015:06:01 10:00:00"))
    (src / "A" / "NULL.jpg.json").write_text("{}")
    (src / "A" / "BOGUS.jpg").write_bytes(jpeg("bogus", "2016:07:01 10:00:00"))
    (src / "A" / "BOGUS.jpg.json").write_text(sidecar(315525610))
    (src / "A" / "ORPHAN.jpg").write_bytes(jpeg("orphan", "2011:02:01 10:00:00"))
    (src / "A" / "GOOD.jpg").write_bytes(jpeg("good", "2001:01:01 10:00:00"))
    (src / "A" / "GOOD.jpg.json").write_text(sidecar(1483228800))
    with zipfile.ZipFile(src / "part.zip", "w") as z:
        z.writestr("E/B/ZIP.jpg", jpeg("zip", "2014:03:01 10:00:00"))
        z.writestr("E/B/ZBOGUS.jpg", jpeg("zbogus", "2013:04:01 10:00:00"))
        z.writestr("E/B/ZBOGUS.jpg.json", sidecar(315525610))
        z.writestr("E/B/LIVE.jpg", jpeg("live", "2012:05:01 10:00:00"))
        z.writestr("E/B/LIVE.mp4", movie(2, 1_600_000_000))
        z.writestr("E/B/CLIP.mp4", movie(30, 1_600_000_000))
        z.writestr("E/B/EMPTY.jpg", b"")
        z.writestr("E/C/ORPHAN.jpg.json", "{}")
    done = run(spark, str(src), str(out))
    assert {r.out_name: (r.outcome, r.folder) for r in done["plan"].collect()} == {
        "NULL.jpg": ("placed", "final/photos/2015/06"),
        "BOGUS.jpg": ("placed", "final/photos/2016/07"),
        "ORPHAN.jpg": ("placed", "final/photos/2011/02"),
        "GOOD.jpg": ("placed", "final/photos/2017/01"),
        "ZIP.jpg": ("placed", "final/photos/2014/03"),
        "ZBOGUS.jpg": ("placed", "final/photos/2013/04"),
        "LIVE.jpg": ("placed", "final/photos/2012/05"),
        "LIVE.mp4": ("motion", "motion"),
        "CLIP.mp4": ("placed", "final/videos/2020/09"),
        "EMPTY.jpg": ("errored", "errors/part/E/B"),
    }
    assert [(r.metric, r.value, r.status) for r in done["checks"].where("section = 'errors'").collect()] == [("skipped", 1, "info")]


def test_another_export_into_the_same_library(spark, tmp_path):
    out = tmp_path / "out"

    def export(name, files):
        src = tmp_path / name
        src.mkdir()
        with zipfile.ZipFile(src / "part.zip", "w") as z:
            for folder, file, tag in files:
                z.writestr(f"{folder}/{file}", jpeg(tag, "2015:06:01 10:00:00"))
        return run(spark, str(src), str(out))

    def held(where):
        return sorted((p.name, p.read_bytes().split(b"\0")[-1]) for p in (out / where).iterdir())

    export("one", [("B", "A.jpg", "first"), ("C", "A.jpg", "second"), ("B", "_X.jpg", "x")])
    first = held("final/photos/2015/06")
    assert [n for n, _ in first] == ["A.jpg", "A_1.jpg", "_X.jpg"]
    # other contents of equal names, one that is there under a number, and one that takes the number's name
    done = export("two", [("A", "A.jpg", "third"), ("B", "A.jpg", "second"), ("B", "A_1.jpg", "fourth"), ("B", "_X.jpg", "y")])
    after = held("final/photos/2015/06")
    assert [n for n, _ in after] == ["A.jpg", "A_1.jpg", "A_1_1.jpg", "A_2.jpg", "_X.jpg", "_X_1.jpg"] and set(first) < set(after)
    assert {r.final_name: r.present for r in done["plan"].collect()} == {"A_2.jpg": False, "A_1.jpg": True, "A_1_1.jpg": False, "_X_1.jpg": False} and done["verdict"].first().safe
    contents = lambda where: {c for _, c in held(where)}
    assert len(contents("final/photos/2015/06")) == 6 and len(contents("Albums/B")) == 5
    again = run(spark, str(tmp_path / "two"), str(out))
    assert {r.outcome for r in again["effects"].collect()} == {"present"} == {r.outcome for r in again["album_effects"].collect()}
    assert held("final/photos/2015/06") == after


def test_effects_do_not_take_other_contents_for_present(spark, tmp_path):
    from pixloom.effects import carry_out

    for name, text in (("a", "new"), ("b", "same"), ("out_a", "old"), ("out_b", "same")):
        (tmp_path / name).write_text(text)
    plan = spark.createDataFrame([(str(tmp_path / n), f"out_{n}", "copy") for n in "ab"], "source string, rel_path string, action string")
    got = {r.rel_path: r.outcome for r in carry_out(plan, str(tmp_path)).collect()}
    assert got["out_b"] == "present" and got["out_a"].startswith("failed") and (tmp_path / "out_a").read_text() == "old"


def test_a_tree_without_archives_and_runs_that_go_on(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "A").mkdir(parents=True)
    for k in range(4):
        (src / "A" / f"P{k}.jpg").write_bytes(jpeg(f"p{k}", "2015:06:01 10:00:00"))
    (src / "A" / "P0.jpg.json").write_text("{}")
    planned = run(spark, str(src), str(out), dry_run=True)
    assert planned["plan"].count() == 4 and not out.exists()
    # an earlier run was interrupted: two files were placed, nothing else was written
    at = out / "final/photos/2015/06"
    at.mkdir(parents=True)
    for k in range(2):
        (at / f"P{k}.jpg").write_bytes(jpeg(f"p{k}", "2015:06:01 10:00:00"))
    done = run(spark, str(src), str(out))
    assert {r.rel_path[-6:]: r.outcome for r in done["effects"].collect()} == {"P0.jpg": "present", "P1.jpg": "present", "P2.jpg": "done", "P3.jpg": "done"}
    assert (at / "P0.jpg.json").read_text() == "{}"
    report = "".join(p.read_text() for p in (out / "pixloom-state/report").glob("part-*"))
    assert "All checks passed." in report
    # ended contents are not done again, unless their file is gone
    (at / "P1.jpg").unlink()
    (src / "A" / "NEW.jpg").write_bytes(jpeg("new", "2015:06:01 10:00:00"))
    again = run(spark, str(src), str(out), rescan=False)
    assert again["plan"].count() == 4 and {r.rel_path[-6:]: r.outcome for r in again["effects"].collect()}["P1.jpg"] == "done"
    assert run(spark, str(src), str(out))["plan"].count() == 5 and (at / "NEW.jpg").exists() and len(list(at.glob("*.jpg"))) == 5


def test_a_lost_file_fails_the_verdict(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "A").mkdir(parents=True)
    (src / "A" / "P.jpg").write_bytes(jpeg("p", "2015:06:01 10:00:00"))
    (src / "A" / "Q.jpg").write_bytes(jpeg("q", "2015:06:01 10:00:00"))
    (out / "final/photos/2015/06/P.jpg.part-x").mkdir(parents=True)
    (out / "final/photos/2015/06/Q.jpg").mkdir()  # a folder is in the way of one file
    done = run(spark, str(src), str(out))
    assert not done["verdict"].first().safe and {r.category for r in done["errors"].collect()} == {"extract_error"}


def test_files_of_any_size_and_unreadable_ones(spark, tmp_path):
    import hashlib

    from pixloom.sources.files import listing, loose_files
    from pixloom.sources.inventory import Inventory

    big = tmp_path / "in" / "big.mp4"
    big.parent.mkdir()
    with open(big, "wb") as f:
        f.truncate(2_200_000_000)
    (tmp_path / "in" / "ok.jpg").write_bytes(jpeg("x"))
    (tmp_path / "in" / "broken.jpg").symlink_to(tmp_path / "in" / "notes")
    (tmp_path / "in" / "notes").mkdir()
    got = {r.name: r for r in loose_files(spark, str(tmp_path / "in")).collect()}
    digest = hashlib.sha256()
    for _ in range(2200):
        digest.update(bytes(1_000_000))
    assert got["big.mp4"].length == 2_200_000_000 and got["big.mp4"].sha256 == digest.hexdigest() and got["ok.jpg"].error is None
    assert listing(spark, str(tmp_path / "in")).where("length > 2147483647").count() == 1
    assert Inventory(spark, str(tmp_path / "inv")).current() is None


def test_names_that_file_listings_leave_out(spark, tmp_path, monkeypatch):
    from pixloom.sources import files

    monkeypatch.setattr(files, "FOLDERS_PER_TASK", 2)
    want = {"_DSC1.jpg", ".hidden.jpg", "_x/y/a.jpg", "b/_c/d/e/f.jpg", "b/with space+%20#.jpg", "b/q.JPG"}
    for name in want:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(jpeg(name))
    got = files.listing(spark, str(tmp_path / "in")).collect()
    assert sorted(r.path for r in got) == sorted(f"{tmp_path}/in/{n}" for n in want)
    assert files.scan(spark, str(tmp_path / "in"))[0].count() == 6
    assert files.listing(spark, str(tmp_path / "nothing")).count() == 0


def test_scans_append_with_lasting_numbers(spark, tmp_path):
    from pixloom.operators.capture import pending_contents
    from pixloom.sources.files import scan
    from pixloom.sources.inventory import Inventory

    src = tmp_path / "in" / "A"
    src.mkdir(parents=True)
    for k in range(8):
        (src / f"m{k}.jpg").write_bytes(jpeg(f"m{k}"))
    inv = Inventory(spark, str(tmp_path / "inv"))
    none = spark.createDataFrame([], "hash string, outcome string")
    assert inv.append(scan(spark, str(tmp_path / "in"))[0]) == 8
    first = {r.hash for r in pending_contents(inv.log(), none, str(tmp_path / "p")).collect()}
    assert len(first) == 8
    for k in range(5):  # these sort before all others
        (src / f"a{k}.jpg").write_bytes(jpeg(f"a{k}"))
    (src / "m7.jpg").write_bytes(jpeg("changed"))
    assert inv.append(scan(spark, str(tmp_path / "in"))[0]) == 6 and inv.append(scan(spark, str(tmp_path / "in"))[0]) == 0
    assert sorted(r.scan_ord for r in inv.log().collect()) == list(range(1, 15)) and inv.current().count() == 13
    second = {r.hash for r in pending_contents(inv.log(), none, str(tmp_path / "p")).collect()}
    assert len(second - first) == 6 and len(second) == 13


def test_the_engines_own_scan_feeds_the_problems(spark, tmp_path):
    from pixloom.operators.timestamps import normalise_times
    from pixloom.sources.files import scan

    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "x.jpg").write_bytes(jpeg("x"))
    (tmp_path / "A" / "y.jpg.json").write_text('{"photoTakenTime": {"timestamp": "1593598830"}}')
    copies, orphans, docs, _ = scan(spark, str(tmp_path))
    assert {"scan_ord", "scanned_at"} <= set(copies.columns) and orphans.columns == ["scan_ord", "inner_name", "ref"] and docs.columns == ["sidecar_id", "ref", "raw"]
    exif = spark.createDataFrame([], "rec_id bigint, source_file string, datetimeoriginal string, createdate string, offsettimeoriginal string, offsettimedigitized string, tz string")
    assert [r.epoch_us for r in normalise_times(docs, exif).collect()] == [1_593_598_830_000_000]
