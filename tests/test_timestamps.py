"""Times in many notations."""

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from pixloom.operators.timestamps import named_instants, normalise_times

EXIF = "rec_id bigint, source_file string, datetimeoriginal string, createdate string, offsettimeoriginal string, offsettimedigitized string, tz string, duration double, origin string"
DOCS = "sidecar_id bigint, ref struct<kind:string,path:string,zip:string,entry:string>, raw string, field string"


def us(*a, micro=0, tz=UTC):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000 + micro


CASES = [
    ("2020:07:01 10:20:30", "+02:00", None, us(2020, 7, 1, 8, 20, 30)),
    ("2020:07:01 10:20:30", "-0330", "Europe/Berlin", us(2020, 7, 1, 13, 50, 30)),
    ("2020:07:01 10:20:30", "junk", "Europe/Berlin", us(2020, 7, 1, 8, 20, 30)),
    ("2020:07:01 10:20:30Z", "+02:00", None, us(2020, 7, 1, 10, 20, 30)),
    ("2020:07:01 10:20:30.5", None, "Asia/Kolkata", us(2020, 7, 1, 4, 50, 30, micro=500_000)),
    ("2020-07-01T10:20:30.123456789+05", None, None, us(2020, 7, 1, 5, 20, 30, micro=123_456)),
    ("2020-07-01T10:20:30+02:00[Europe/Madrid]", None, None, us(2020, 7, 1, 8, 20, 30)),
    ("20200701T102030Z", None, None, us(2020, 7, 1, 10, 20, 30)),
    ("20200701102030", "+01:00", None, us(2020, 7, 1, 9, 20, 30)),
    ("01.07.2020 10:20:30", "Z", None, us(2020, 7, 1, 10, 20, 30)),
    ("2020/07/01 10:20", "Z", None, us(2020, 7, 1, 10, 20)),
    ("2020:07:01 1:20:30 PM", "Z", None, us(2020, 7, 1, 13, 20, 30)),
    ("2020:07:01 12:20:30 AM", "Z", None, us(2020, 7, 1, 0, 20, 30)),
    ("2020:07:01 13:20:30 AM", "Z", None, None),
    ("Wed Jul  1 10:20:30 2020", "Z", None, us(2020, 7, 1, 10, 20, 30)),
    ("Wed, 01 Jul 2020 10:20:30 +0930", None, None, us(2020, 7, 1, 0, 50, 30)),
    ("2020:07:01 10:20:30 CEST", None, "America/Bogota", us(2020, 7, 1, 8, 20, 30)),
    ("2020:01:01 10:20:30 EST", None, None, us(2020, 1, 1, 15, 20, 30)),
    ("1593598830", None, None, 1_593_598_830_000_000),
    ("1593598830123", None, None, 1_593_598_830_123_000),
    ("1593598830123456", None, None, 1_593_598_830_123_456),
    ("  2020:07:01 10:20:30  ", "Z", None, us(2020, 7, 1, 10, 20, 30)),
    ("2020:10:25 02:30:00", None, "Europe/Berlin", us(2020, 10, 25, 0, 30)),  # twice: the earlier
    ("2020:03:29 02:30:00", None, "Europe/Berlin", None),  # skipped
    ("2020:07:01 10:20:30", None, None, None),
    ("2020:07:01", "Z", None, None),
    ("2020", "Z", None, None),
    ("2020:02:30 10:20:30", "Z", None, None),
    ("2020:07:01 25:20:30", "Z", None, None),
    ("0000:00:00 00:00:00", "Z", None, None),
    ("2020:07:01 10:20:30", None, "Nowhere/City", None),
    ("2020:07:01 10:20:30 foo", "Z", None, None),
    ("n/a", "Z", None, None),
    ("", "Z", None, None),
    (None, "Z", None, None),
    ("x" * 100_000, "Z", None, None),
]


def test_exif_cases(spark):
    rows = [(i, f"/a/b/c/{i}.jpg", t, None, o, None, z, None, "clash") for i, (t, o, z, _) in enumerate(CASES)]
    got = {r.rec_id: r.epoch_us for r in named_instants(normalise_times(spark.createDataFrame([], DOCS), spark.createDataFrame(rows + rows[:3], EXIF))).distinct().collect()}
    assert got == {i: want for i, (_, _, _, want) in enumerate(CASES) if want is not None}


@pytest.mark.parametrize(
    "raw,expected",
    [
        ('{"photoTakenTime": {"timestamp": "1593598830", "formatted": "x"}}', {"photoTakenTime": 1_593_598_830_000_000}),
        ('{"photoTakenTime": {"timestamp": 1593598830.25}}', {"photoTakenTime": 1_593_598_830_250_000}),
        ('{"photoTakenTime": {"timestamp": "", "formatted": "1 Jul 2020, 10:20:30 UTC"}}', {"photoTakenTime": us(2020, 7, 1, 10, 20, 30)}),
        ('{"photoTakenTime": {"timestamp": "soon", "formatted": "Jul 1, 2020, 1:20:30\\u202fPM UTC"}}', {"photoTakenTime": us(2020, 7, 1, 13, 20, 30)}),
        ('{"creationTime": {"formatted": "1. Juli 2020, 10:20:30 UTC"}}', {"creationTime": us(2020, 7, 1, 10, 20, 30)}),
        ('{"creationTime": {"formatted": "1 juillet 2020 à 10:20:30 UTC"}}', {"creationTime": us(2020, 7, 1, 10, 20, 30)}),
        ('{"creationTime": {"formatted": "3. März 2020, 10:20:30 UTC"}}', {"creationTime": us(2020, 3, 3, 10, 20, 30)}),
        ('{"creationTime": {"formatted": "03.04.2020 10:20:30"}, "timeZone": "America/New_York"}', {"creationTime": us(2020, 4, 3, 10, 20, 30, tz=ZoneInfo("America/New_York"))}),
        ('{"creationTime": {"formatted": "03.04.2020 10:20:30"}}', {}),
        ('{"photoTakenTime": "2020-07-01T10:20:30.123+02:00"}', {"photoTakenTime": us(2020, 7, 1, 8, 20, 30, micro=123_000)}),
        ('{"photoTakenTime": null, "creationTime": []}', {}),
        ('[{"photoTakenTime": {"timestamp": "1593598830"}}]', {}),
        ('{"photoTakenTime": {"timestamp": "1593598830"', {}),
        ("null", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_documents(spark, raw, expected):
    docs = spark.createDataFrame([(1, ("dir", "/a/b/c/x.jpg.json", None, None), raw, "clash")], DOCS)
    got = {r.field: r.epoch_us for r in named_instants(normalise_times(docs, spark.createDataFrame([], EXIF))).collect()}
    assert got == expected


def test_missing_zones_follow_the_history_of_their_source(spark):
    rows, docs = [], []
    for i in range(60):  # one camera that moves from +1 to +9 hours in June
        local = datetime(2020, 1 + i // 5, 1 + i % 5 * 5, 12, 0, tzinfo=UTC)
        off = 1 if i < 30 else 9
        rows.append((i, f"/srv/in/lib1/{i}.jpg", local.strftime("%Y:%m:%d %H:%M:%S"), None, f"+0{off}:00" if i % 3 == 0 else None, None, None, None, "x"))
        if i % 3 == 1:  # no zone, but a document of the same file tells the instant
            docs.append((i, ("dir", f"/srv/in/lib1/{i}.jpg.supplemental-metadata.json", None, None), '{"photoTakenTime": {"timestamp": "%d"}}' % (local.timestamp() - off * 3600), "x"))
    rows.append((99, "/srv/in/lib2/a.jpg", "2020:07:01 10:20:30", None, None, None, None, None, "x"))
    times = {r.rec_id: r for r in normalise_times(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, EXIF)).where("origin = 'exif'").collect()}
    wrong = [i for i in range(60) if times[i].epoch_us != int(datetime(2020, 1 + i // 5, 1 + i % 5 * 5, 12, tzinfo=UTC).timestamp() - (1 if i < 30 else 9) * 3600) * 1_000_000]
    assert len(wrong) <= 2 and set(wrong) <= {28, 29}  # the month in which the clock was changed holds both offsets
    assert times[1].zone_source == "estimated" and times[0].zone_source == "own"
    assert times[99].epoch_us is None and times[99].zone_source is None


def test_partitions_do_not_matter(spark):
    rows = [(i, f"/a/b/c/{i}.jpg", t, None, o, None, z, None, "clash") for i, (t, o, z, _) in enumerate(CASES)]
    df, none = spark.createDataFrame(rows, EXIF), spark.createDataFrame([], DOCS)
    a, b = (sorted(map(str, normalise_times(none, df.repartition(n)).orderBy(F.rand()).collect())) for n in (1, 5))
    assert a == b


def test_missing_zones_of_sidecars_are_estimated_too(spark):
    rows = [(i, f"/srv/in/lib1/{i}.jpg", f"2020:0{3 + 2 * (i % 2)}:0{1 + i} 12:00:00", None, "+02:00", None, None, None, "x") for i in range(6)]
    said = '{"creationTime": {"formatted": "0%d.0%d.2020 10:20:30"}}'
    docs = [(k, ("dir", f"/srv/in/{lib}/s{k}.jpg.json", None, None), said % (3, month), "x") for k, (lib, month) in enumerate((("lib1", 3), ("lib1", 4), ("lib2", 3)))]
    times = normalise_times(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, EXIF))
    got = {r.rec_id: (r.epoch_us, r.zone_source) for r in times.where("origin = 'sidecar_docs'").collect()}
    assert got == {0: (us(2020, 3, 3, 8, 20, 30), "estimated"), 1: (us(2020, 4, 3, 8, 20, 30), "estimated"), 2: (None, None)}
    assert named_instants(times).where("origin = 'sidecar_docs'").count() == 0


def berlin_year(stated_every=3, name="/srv/in/lib1/IMG_{}.jpg"):
    """Readings of a camera that is set to Berlin through both changes of the clock; every third states its offset."""
    rows, want = [], {}
    for i in range(243):
        at = datetime(2020, 1, 3, 5, 20, 30, tzinfo=UTC).timestamp() + i * 1.5 * 86_400
        local = datetime.fromtimestamp(at, ZoneInfo("Europe/Berlin"))
        rows.append((i, name.format(i), local.strftime("%Y:%m:%d %H:%M:%S"), None, local.strftime("%z") if i % stated_every == 0 else None, None, None, None, "x"))
        want[i] = int(at) * 1_000_000
    return rows, want


def test_zones_change_with_daylight_saving(spark):
    rows, want = berlin_year()
    times = normalise_times(spark.createDataFrame([], DOCS), spark.createDataFrame(rows, EXIF)).collect()
    assert {r.rec_id: r.epoch_us for r in times} == want and {r.evidence for r in times} >= {None, "camera"}


def test_cameras_of_a_library_are_not_mixed(spark):
    rows, want = berlin_year()
    more, tokyo = [], {}
    for i in range(243):  # another camera of the library, in Tokyo
        at = datetime(2020, 1, 3, 15, 0, 0, tzinfo=UTC).timestamp() + i * 1.5 * 86_400
        more.append((1000 + i, f"/srv/in/lib1/DSC{i}.jpg", datetime.fromtimestamp(at, ZoneInfo("Asia/Tokyo")).strftime("%Y:%m:%d %H:%M:%S"), None, None, None, "Asia/Tokyo" if i % 3 == 0 else None, None, "x"))
        tokyo[1000 + i] = int(at) * 1_000_000
    times = {r.rec_id: r.epoch_us for r in normalise_times(spark.createDataFrame([], DOCS), spark.createDataFrame(rows + more, EXIF)).collect()}
    assert times == want | tokyo


def test_nearest_evidence_comes_first(spark):
    rows, _ = berlin_year()
    rows += [
        (900, "/srv/in/lib1/IMG_trip1.jpg", "2020:06:10 20:00:00", None, None, None, "America/Bogota", None, "x"),
        (901, "/srv/in/lib1/IMG_trip2.jpg", "2020:06:10 21:30:00", None, None, None, None, None, "x"),  # an hour and a half later
        (902, "/srv/in/lib1/IMG_trip3.jpg", "2020:06:11 06:00:00", None, None, None, None, None, "x"),  # its document tells
    ]
    docs = [(5, ("dir", "/srv/in/lib1/IMG_trip3.jpg.json", None, None), '{"photoTakenTime": {"timestamp": "%d"}}' % datetime(2020, 6, 10, 21, 0, 1, tzinfo=UTC).timestamp(), "x")]
    got = {r.rec_id: (r.epoch_us, r.evidence) for r in normalise_times(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, EXIF)).where("origin = 'exif'").collect()}
    assert got[901] == (us(2020, 6, 11, 2, 30), "neighbour") and got[902] == (us(2020, 6, 10, 21, 0), "document")


def test_offsets_of_zones():
    import numpy as np

    from pixloom.operators.timestamps import _zone_offsets, _zone_steps

    for zone in ("Europe/Berlin", "America/St_Johns", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo"):
        hours = np.arange(315_000, 430_000, 7)
        for h in hours[::97].tolist() + [h for h in range(438_000, 447_000)][::5]:
            wall = datetime.fromtimestamp(h * 3600, UTC).replace(tzinfo=None)
            off = wall.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds() / 60
            gap = wall.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None) != wall
            assert gap or _zone_offsets(_zone_steps(zone), np.array([h]))[0] == off, (zone, wall)
