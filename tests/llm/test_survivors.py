"""Surviving records against pairwise comparison."""

import random
from datetime import datetime, timedelta

from pixloom.llm.survivors import best_records, reliabilities, undisputed

GROUPS = "group_id bigint, scan_ord bigint, path string, name string, size_bytes bigint, w int, h int, rank_no int, suggest_keep boolean, reviewed_at timestamp, claims string"
COPIES = "scan_ord bigint, src string, path string, zip string, entry string, sidecar struct<kind:string,path:string,zip:string,entry:string>, dated string"
DOCS = "sidecar_id bigint, ref struct<kind:string,path:string,zip:string,entry:string>, raw string"


def make(spark, seed=0, n=400):
    r = random.Random(seed)
    groups, copies, docs, facts = [], [], [], {}
    for i in range(n):
        loose, place, dated = r.random() < 0.6, r.choice(["Album", "Trash", "ARCHIVE", "x"]), r.random() < 0.6
        ref = ("dir", f"/a/{i}.json", None, None) if r.random() < 0.8 else None
        copies.append((i, "dir" if loose else "zip", f"/a/{place}/{i}.jpg" if loose else None, None if loose else "/a/z.zip", None if loose else f"T/{place}/{i}.jpg", ref, "x"))
        if ref:
            docs.append((i, ref, '{"photoTakenTime": {"timestamp": "1593598830"}}' if dated else r.choice([None, "{", "{}", '{"photoTakenTime": {"formatted": "1 Jul 2020, 10:00:00"}}'])))
        facts[i] = (int(bool(ref) and dated), int(loose), {"Trash": 0, "ARCHIVE": 1}.get(place, 2))
    last = {}
    for _ in range(n * 2):
        g, s = (0 if r.random() < 0.33 else r.randrange(1, 60)), r.randrange(n)
        at = datetime(2025, 1, 1) + timedelta(minutes=len(groups))
        keep, size = r.choice([True, False, None]), r.choice([None, 10, 20, 30])
        groups.append((g, s, None, f"n{s}", size, r.choice([0, 100]), 50, 0, keep, at, "x"))
        last[g, s] = (int(keep is True), -1 if size is None else size)
    groups += groups[:30] + [(None, 1, None, None, None, None, None, None, None, None, "x"), (5, None, None, None, None, None, None, None, None, None, "x")]
    r.shuffle(groups)
    by = {}
    for (g, s), (k, z) in last.items():
        by.setdefault(g, {})[s] = (*facts[s], k, z)
    want = {(g, s) for g, m in by.items() for s, v in m.items() if all(all(a >= b for a, b in zip(v, w)) and v != w for t, w in m.items() if t != s)}
    return spark.createDataFrame(groups, GROUPS), spark.createDataFrame(copies, COPIES), spark.createDataFrame(docs, DOCS), want, by


def test_undisputed_against_brute_force(spark):
    groups, copies, docs, want, by = make(spark)
    best = best_records(groups, copies, docs).cache()
    assert {(r.group_id, r.scan_ord) for r in undisputed(best).collect()} == want and want
    rows = best.collect()
    assert len(rows) == len(by)
    for r in rows:  # the survivor is not beaten in everything by another member
        mine = by[r.group_id][r.scan_ord]
        assert not any(all(a > b for a, b in zip(v, mine)) for v in by[r.group_id].values())
        assert r.dims in (None, "100x50") and 0 < r.support <= 1


def test_members_that_copies_does_not_know(spark):
    groups, copies, docs, _, _ = make(spark)
    lone = groups.where("group_id = 7")
    assert best_records(lone, copies.limit(0), docs.limit(0)).count() == 1
    assert best_records(groups.limit(0), copies, docs).count() == 0


def test_reliable_respects_gain_weight(spark):
    patterns = spark.createDataFrame([([0b00111, 0b11000], 90), ([0b00110, 0b11001], 5)], "claims array<int>, n bigint")
    w = reliabilities(patterns)
    assert abs(sum(w) - 1) < 1e-9 and min(w[0], w[1], w[2]) > max(w[3], w[4])


def test_unreliable_sources_are_found_out(spark):
    """Respects that claim a planted true member with a known chance: those that err lose weight, and the vote beats equal weights."""
    r = random.Random(6)
    chance = (0.9, 0.85, 0.8, 0.3, 0.25)  # dated, loose, place, kept, size
    groups = []
    for _ in range(3000):
        claimed = [0, 0, 0]  # the true member and two others
        for i, p in enumerate(chance):
            claimed[0 if r.random() < p else r.choice((1, 2))] |= 1 << i
        groups.append(claimed)
    count = {}
    for c in groups:
        key = tuple(sorted(set(c) - {0}))
        count[key] = count.get(key, 0) + 1
    w = reliabilities(spark.createDataFrame([(list(k), n) for k, n in count.items()], "claims array<int>, n bigint"))
    assert min(w[:3]) > 1.5 * max(w[3:])
    support = lambda m, w: round(sum(x for i, x in enumerate(w) if m >> i & 1), 9)
    right = lambda w: sum(support(c[0], w) > max(support(c[1], w), support(c[2], w)) for c in groups) / len(groups)
    assert right(w) > 0.93 and right(w) > right([0.2] * 5) + 0.02


def test_iteration_ends_where_winners_take_turns(spark):
    patterns = spark.createDataFrame([([1, 2], 3), ([2, 4], 3), ([4, 1], 3), ([8, 16], 1), ([5, 10], 2)], "claims array<int>, n bigint")
    assert abs(sum(reliabilities(patterns)) - 1) < 1e-9
    assert reliabilities(patterns.limit(0)) == [0.2] * 5
