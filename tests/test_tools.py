"""Tools on a library: extensions, months, look-alikes; and the tags of other picture types."""

import struct

import pytest
from test_library import jpeg

from pixloom import cli
from pixloom.plans import tools
from pixloom.sources.probe import read_tags


@pytest.fixture
def session(spark, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    return spark


def test_extensions(session, tmp_path):
    (tmp_path / "A").mkdir()
    for name, tag in (("one.png", "1"), ("two.jpg", "2"), ("two.heic", "3"), ("three.jpeg", "4")):
        (tmp_path / "A" / name).write_bytes(jpeg(tag))
    (tmp_path / "A" / "short.png").write_bytes(b"x")
    assert cli.main(["fix-extensions", "--dir", str(tmp_path), "--dry-run"]) == 0 and (tmp_path / "A" / "one.png").exists()
    assert cli.main(["fix-extensions", "--dir", str(tmp_path), "--yes"]) == 0
    held = {p.name: p.read_bytes() for p in (tmp_path / "A").iterdir()}
    assert set(held) == {"one.jpg", "two.jpg", "two_1.jpg", "three.jpeg", "short.png"} and held["two.jpg"] == jpeg("2") and held["two_1.jpg"] == jpeg("3")
    assert tools.extension_moves(session, str(tmp_path)).count() == 0


def test_refolder(session, tmp_path):
    unknown = tmp_path / "photos" / "unknown" / "deep"
    unknown.mkdir(parents=True)
    (tmp_path / "photos/2015/06").mkdir(parents=True)
    (tmp_path / "photos/2015/06/a.jpg").write_bytes(jpeg("there"))
    (unknown / "a.jpg").write_bytes(jpeg("dated", "2015:06:01 10:00:00"))
    (unknown / "b.jpg").write_bytes(jpeg("undated"))
    (unknown / "c.jpg").write_bytes(jpeg("bogus", "1980:06:01 10:00:00"))
    assert cli.main(["re-folder", "--final", str(tmp_path), "--yes"]) == 0
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.jpg")) == ["photos/2015/06/a.jpg", "photos/2015/06/a_1.jpg", "photos/unknown/deep/b.jpg", "photos/unknown/deep/c.jpg"]


def test_questions(session, tmp_path, monkeypatch):
    (tmp_path / "one.png").write_bytes(jpeg("1"))
    monkeypatch.setattr("builtins.input", lambda *_: "no")
    assert cli.main(["fix-extensions", "--dir", str(tmp_path)]) == 0 and (tmp_path / "one.png").exists()
    monkeypatch.setattr("builtins.input", lambda *_: (_ for _ in ()).throw(EOFError))
    assert cli.main(["fix-extensions", "--dir", str(tmp_path)]) == 0 and (tmp_path / "one.png").exists()
    monkeypatch.setattr("builtins.input", lambda *_: "yes")
    assert cli.main(["fix-extensions", "--dir", str(tmp_path)]) == 0 and (tmp_path / "one.jpg").exists()
    with pytest.raises(SystemExit):
        cli.main(["fix-extensions", "--dir", str(tmp_path / "none")])


def bmp(path, shade, side=32):
    row = b"".join(bytes((x * 8 % 256, shade(x), 40)) for x in (k * 32 // side for k in range(side)))
    data = row * side
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, side, side, 1, 24, 0, len(data), 0, 0, 0, 0) + data)


def test_look_alikes_are_saved_and_removed(session, tmp_path):
    photos = tmp_path / "final" / "photos"
    photos.mkdir(parents=True)
    bmp(photos / "a.bmp", lambda x: x * 4 % 256)
    bmp(photos / "b.bmp", lambda x: x * 4 % 256, 64)
    bmp(photos / "c.bmp", lambda x: 255 - x * 7 % 256)
    tools.prepare_review(session, str(tmp_path), True)
    groups = tools.load_groups(session, f"{tmp_path}/near-dup-groups", str(photos))
    assert [(r.path.rsplit("/")[-1], r.rank_no, r.suggest_keep) for r in groups.orderBy("rank_no").collect()] == [("b.bmp", 0, True), ("a.bmp", 1, False)]
    assert "--groups" in (tmp_path / "review-similar.sh").read_text()
    (tmp_path / "chosen.txt").write_text(f"{photos}/a.bmp\n{photos}/unknown.bmp\n")
    assert cli.main(["similar", "--dir", str(photos), "--groups", f"{tmp_path}/near-dup-groups", "--selection", f"{tmp_path}/chosen.txt", "--removed", f"{tmp_path}/gone", "--yes"]) == 0
    assert not (photos / "a.bmp").exists() and (tmp_path / "gone/a.bmp").exists()
    assert tools.load_groups(session, f"{tmp_path}/near-dup-groups", str(photos)).count() == 0  # one left is no group


def tiff(text, order="<"):
    data = text.encode() + b"\0"
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "HHHIII", 1, 0x8769, 4, 1, 26, 0) + struct.pack(order + "HHHIII", 1, 0x9003, 2, len(data), 44, 0) + data


@pytest.mark.parametrize(
    "wrap",
    [
        lambda t: t,
        lambda t: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 3, b"abcd") + b"xyz" + bytes(4) + struct.pack(">I4s", len(t), b"eXIf") + t + bytes(4),
        lambda t: b"RIFF\0\0\0\0WEBP" + struct.pack("<4sI", b"VP8 ", 3) + b"xyz\0" + struct.pack("<4sI", b"EXIF", len(t)) + t,
        lambda t: struct.pack(">I4s4sI", 16, b"ftyp", b"heic", 0) + b"Exif\0\0no" + b"\0\0\0\6Exif\0\0" + t,
    ],
)
@pytest.mark.parametrize("order", "<>")
def test_tags_of_picture_types(wrap, order):
    text = "2019:05:02 10:00:00"
    data = wrap(tiff(text, order))
    assert read_tags(data) == {"original": text}
    assert all(read_tags(data[:k]) in ({}, {"original": text}) or read_tags(data[:k])["original"] in text for k in range(0, len(data), 3))
