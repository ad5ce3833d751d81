"""Tags of places: each coordinate is guarded alone."""

import json

import pytest

import __spark_entry__ as entry


@pytest.fixture
def sidecars(spark, tmp_path):
    def write(rows):
        docs = [(i, {"kind": "dir", "path": f"/srv/import/A/{name}.json", "zip": None, "entry": None}, json.dumps({"geoData": dict(zip(("latitude", "longitude", "altitude"), g))} if g else {})) for i, name, g in rows]
        spark.createDataFrame(docs, "sidecar_id bigint, ref struct<kind:string, path:string, zip:string, entry:string>, raw string").write.parquet(f"{tmp_path}/sidecar_docs.parquet")
        return str(tmp_path)

    return write


def test_gps_tags(spark, sidecars):
    at = sidecars([(1, "a.jpg", (0, 10, 0.0)), (2, "b.jpg", (-29.8015, 0, 96.0)), (3, "c.mp4", (1.5, 2.5, 3.5)), (4, "d.jpg", ("1e1", None, "x")), (5, "e.jpg", None), (6, "f.jpg", (0.00001, 1e-7, 0))])
    got = {(r.id, r.tag): r.value for r in entry.queries()["gps_tags"](spark, at).collect()}
    lat, lon = ("GPSLatitude", "GPSLatitudeRef"), ("GPSLongitude", "GPSLongitudeRef")
    want = {(1, t): 10.0 for t in lon} | {(2, t): -29.8015 for t in lat} | {(2, "GPSAltitude"): 96.0} | {(4, t): 10.0 for t in lat} | {(6, t): 0.00001 for t in lat} | {(6, t): 1e-7 for t in lon}
    assert got == want
    assert not any(r.tag.startswith("GPS") for r in entry.queries()["tag_plan"](spark, at).collect())
