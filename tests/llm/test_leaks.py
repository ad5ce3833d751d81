"""Leaked items: single cases, and the search against an alignment of everything with everything."""

import random

from pixloom.llm import leaks

VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("arn", "el", "iston", "ovent", "ush", "atic", "enly")]


def item(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


ITEMS = [(i, item(i)) for i in range(30)]
SHARED = (90, " ".join(item(0).split()[:45]) + " " + item(777, 15))


def altered(words, every, r):
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            k = r.randrange(3)
            out += ["changed"] if k == 0 else [] if k == 1 else [w, "added"]
        else:
            out.append(w)
    return out


def found(texts, items=ITEMS):
    index = leaks.Index.build(items)
    return [{i for i, _ in index.search(t)} for t in texts]


def test_writing_does_not_matter():
    w = ITEMS[3][1].split()[10:40]
    noise = item(500, 200)
    forms = [
        " ".join(w), " ".join(w).upper(), "\n> ".join(w), "<p>" + "</b> <b>".join(w) + "</p>", "*" + "* _".join(w) + "_", ", ".join(x.capitalize() for x in w) + ".", " ".join(x[:1] + "​" + x[1:] for x in w),
        " ".join(x[:1] + "­" + x[1:] for x in w), "&nbsp;".join(w), "\\u0020".join(w), "%20".join(w), " ".join("".join(c + "́" if c == "e" else c for c in x) for x in w), " ".join(w), " ".join(x[:2] + "-\n" + x[2:] if i % 9 == 8 else x for i, x in enumerate(w)),
    ]
    texts = [f"{noise} {f} {noise}" for f in forms]
    hits = found(texts)
    assert all(3 in h for h in hits[:-1])


def test_parts_edits_and_negatives():
    r = random.Random(4)
    w = ITEMS[5][1].split()
    noise = item(501, 300)
    assert found([f"{noise} {' '.join(altered(w[a : a + n], 8, r))} {noise}" for n in (25, 40, 60) for a in (0, 60 - n) for _ in range(5)]) == [{5}] * 30
    shuffled = w[:]
    r.shuffle(shuffled)
    short = [" ".join(w[10:19]), noise, " ".join(shuffled), " ".join(altered(w, 3, r)), "", "   ", " ".join(w[5:14]) + " " + noise + " " + " ".join(w[30:39])]
    assert found(short) == [set()] * len(short)


def test_long_documents_and_shared_passages():
    items = [*ITEMS, SHARED]
    long = " ".join(item(600 + k, 400) for k in range(40))
    whole = long + " " + item(0) + " " + long
    hits = found([whole, " ".join(t for _, t in ITEMS), " ".join(item(0).split()[:40])], items)
    assert hits[0] == {0, 90} and hits[1] == {i for i, _ in ITEMS} | {90} and hits[2] == {0, 90}


def test_search_is_all_that_alignment_finds():
    r = random.Random(8)
    docs = []
    for k in range(150):
        out = item(1000 + k, r.randrange(120)).split()
        for _ in range(r.randrange(3)):
            w = r.choice(ITEMS)[1].split()
            n = r.randrange(5, 60)
            a = r.randrange(0, 60 - n)
            out += altered(w[a : a + n], r.choice([4, 8, 9, 12, 50]), r) + item(2000 + k, 20).split()
        docs.append(" ".join(out))
    want = [{i for i, t in ITEMS if leaks.reproduces(leaks.plain_words(d), leaks.plain_words(t))[0]} for d in docs]
    got = found(docs)
    missed = sum(len(w - g) for w, g in zip(want, got))
    assert sum(map(len, want)) > 60 and missed <= 0.02 * sum(map(len, want)) and not any(g - w for w, g in zip(want, got))


def test_tables(spark):
    docs = [(1, ITEMS[0][1], "x"), (1, ITEMS[0][1], "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", "x"), (5, "lang " * 50_000 + ITEMS[1][1], "x"), (None, ITEMS[2][1], "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(a, t, "x") for a, t in ITEMS] + [(100, None, "x"), (101, "", "x"), (None, "a b c", "x"), (102, "too short", "x")], "item_id bigint, text string, share string")
    got = {(r.doc_id, r.item_id): r.share for r in leaks.leaked_items(d, i).collect()}
    assert got == {(1, 0): 1.0, (5, 1): 1.0}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i, block=7).collect()} == set(got)
    assert leaks.leaked_items(d.limit(0), i).count() == 0 and leaks.leaked_items(d, i.limit(0)).count() == 0
