"""Change capture: whatever fails in between, nothing is skipped or counted twice."""

import random

import pytest
from pyspark.sql import functions as F

from pixloom.operators.capture import ChangeCapture, finished_hashes, pending_contents

COPIES = "scan_ord bigint, sha256 string, path string, zip string, entry string, scanned_at timestamp, hash string"
EXTRACTED = "hash string, outcome string, place string"


def h(n):
    return f"{n:064x}"


def log_of(spark, rows):
    return spark.createDataFrame([(o, h(s) if s is not None else None, p, None, None, t, "clash") for o, s, p, t in rows], COPIES)


def day(n):
    from datetime import datetime, timedelta

    return datetime(2025, 1, 1) + timedelta(days=n)


def brute(rows, done):
    last = {}
    for o, s, p, t in rows:
        if s is not None and p is not None and ((t is not None, t, o) > last.get(p, (False, None, -1))[:3] if p in last else True):
            last[p] = (t is not None, t, o, s)
    return {h(v[3]) for v in last.values()} - {h(d) for d in done}


def rows_of(n, seed=0, first=0):
    r = random.Random(seed)
    # one place and one content hold a third of the rows
    return [(first + i, None if r.random() < 0.05 else 1 if r.random() < 0.33 else r.randrange(2, 60), "hot" if r.random() < 0.33 else f"p{r.randrange(40)}", day(r.randrange(300))) for i in range(n)]


def test_pending_against_brute_force(spark, tmp_path):
    rows = rows_of(400)
    done = spark.createDataFrame([("sha256:" + h(1).upper() + "\n", "placed", "x"), (h(5), "failed", "x"), (None, "placed", "x"), (f" {h(7)}", "motion", "x"), ("junk", "placed", "x"), (h(9), None, "x")], EXTRACTED)
    got = [r.hash for r in pending_contents(log_of(spark, rows + rows[:20]), done, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, [1, 7])


def test_empty(spark, tmp_path):
    none, done = log_of(spark, []), spark.createDataFrame([], EXTRACTED)
    assert pending_contents(none, done, str(tmp_path)).count() == 0
    assert finished_hashes(done).count() == 0


def capture(spark, root):
    return ChangeCapture(spark, root, "path", "scanned_at", "scan_ord", ["sha256"], partitions=4)


def state(c):
    return sorted((r.path, r.sha256, r.scan_ord) for r in c.sink().collect())


@pytest.mark.parametrize("fail_in", ["before", "during", "before_commit"])
def test_interrupted_runs_are_replayed(spark, tmp_path, monkeypatch, fail_in):
    first, more, late = rows_of(100), rows_of(60, 1, 100), rows_of(40, 2, 160)
    whole = capture(spark, str(tmp_path / "whole"))
    whole.run(log_of(spark, first + more + late))
    c = capture(spark, str(tmp_path / "steps"))
    c.run(log_of(spark, first))
    log = log_of(spark, first + more)
    if fail_in == "before":
        assert c.plan(log) is not None  # planned, then the process was lost
    elif fail_in == "during":
        batch = c.plan(log)
        c.rows(log, batch).limit(3).write.parquet(f"{tmp_path}/steps/sink/{batch}")  # half a sink
    else:
        batch = c.plan(log)
        c.apply(log, batch)
        import shutil

        shutil.rmtree(f"{tmp_path}/steps/done/{batch}")  # all but the commit
    c.run(log_of(spark, first + more + late))
    assert state(c) == state(whole)
    assert capture(spark, str(tmp_path / "steps")).plan(log_of(spark, first + more + late)) is None  # nothing is new


def test_a_batch_is_what_was_planned(spark, tmp_path):
    c = capture(spark, str(tmp_path))
    batch = c.plan(log_of(spark, rows_of(50)))
    grown = log_of(spark, rows_of(50) + rows_of(30, 3, 50))
    assert {r.offset for r in c.rows(grown, batch).collect()} == {o for o, _, p, _ in rows_of(50)}


def test_late_rows_are_captured_and_old_versions_lose(spark, tmp_path):
    c = capture(spark, str(tmp_path))
    c.run(log_of(spark, [(1, 5, "a", day(10)), (2, 6, "b", day(10))]))
    c.run(log_of(spark, [(1, 5, "a", day(10)), (2, 6, "b", day(10)), (3, 7, "a", day(3)), (4, 8, "b", day(20)), (5, 9, "c", day(1))]))
    assert state(c) == [("a", h(5), 1), ("b", h(8), 4), ("c", h(9), 5)]
    assert c.sink().agg(F.count("*")).first()[0] == 3


def test_many_runs_keep_few_parts(spark, tmp_path, monkeypatch):
    from pixloom.operators import capture as module

    monkeypatch.setattr(module, "FAN", 3)
    c, rows = capture(spark, str(tmp_path / "a")), []
    for k in range(11):
        rows += rows_of(15, k, 15 * k)
        c.run(log_of(spark, rows))
    whole = capture(spark, str(tmp_path / "b"))
    whole.run(log_of(spark, rows))
    assert state(c) == state(whole)
    assert sorted(level for _, level in c._parts(10)) == [0, 0, 2]
    assert len(list((tmp_path / "a" / "sink").iterdir())) <= 3 + 3  # those in use, and those that the last state used
    assert {r.scan_ord for r in c.changes().collect()} <= set(range(150, 165)) and c.run(log_of(spark, rows)).count() == c.sink().count()
    assert c._batches("done")[-1] == 10  # nothing new: no batch


def test_old_rows_are_not_read(spark, tmp_path):
    for n in range(3):
        log_of(spark, rows_of(200, n, 200 * n)).write.parquet(f"{tmp_path}/log/{n}")
    read = lambda k: spark.read.parquet(*[f"{tmp_path}/log/{n}" for n in range(k)])
    c = capture(spark, str(tmp_path / "state"))
    c.run(read(2))
    batch = c.plan(read(3))
    fresh = c.rows(read(3), batch)
    text = fresh._jdf.queryExecution().toString()
    least = min(low for low, _ in c._ends(batch).values())
    assert least > 300 and f"GreaterThan(scan_ord,{least})" in text.replace(" ", "")
    assert {r.offset for r in fresh.collect()} == {o for o, _, p, _ in rows_of(200, 2, 400)}
