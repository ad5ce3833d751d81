"""Edits of a passage may lie anywhere: close together, and at its ends."""

import random

from test_leaks import ITEMS, VOCABULARY, found, item

from pixloom.llm import leaks


def scattered(words, edits, r):
    out = [[w] for w in words]
    for i in r.sample(range(len(words)), edits):
        out[i] = r.choice((["changed"], [], [words[i], "added"]))
    return [w for x in out for w in x]


def test_edits_anywhere():
    r = random.Random(11)
    w = ITEMS[7][1].split()
    texts = [f"{item(700 + k, 60)} {' '.join(scattered(w[a : a + n], n // 8, r))} {item(800 + k, 60)}" for n in (20, 28, 40, 60) for k in range(50) for a in [r.randrange(61 - n)]]
    assert [7 in h for h in found(texts)].count(False) == 0


def test_all_words_of_a_stretch_count():
    w = ITEMS[7][1].split()
    text = w[:3] + ["changed"] + w[4:56] + ["changed"] + w[57:]
    assert leaks.reproduces(text, w) == (True, 58 / 60)


def test_stretches_are_those_of_all_pairs():
    def brute(a, b):  # edit distance of every stretch of b to every stretch of a
        for first in range(len(b)):
            row = {(i, j): 0 for i in range(len(a) + 1) for j in [first]}
            for j in range(first + 1, len(b) + 1):
                for i in range(len(a) + 1):
                    row[i, j] = min([row[i, j - 1] + 1, *([row[i - 1, j - 1] + (a[i - 1] != b[j - 1]), row[i - 1, j] + 1] if i else [])])
                    if j - first >= leaks.LEAST_WORDS and row[i, j] * 8 <= j - first:
                        return True
        return False

    r = random.Random(3)
    seen = []
    for _ in range(120):
        b = [r.choice(VOCABULARY) for _ in range(r.randrange(15, 45))]
        a = [r.choice(VOCABULARY) for _ in range(5)] + scattered(b, min(len(b), r.randrange(9)), r) + [r.choice(VOCABULARY) for _ in range(5)]
        seen.append(brute(a, b))
        assert (leaks.longest_stretch(a, b) > 0) == (leaks.longest_stretch(a, b, 4) > 0) == seen[-1]
    assert 20 < sum(seen) < 100


def test_bound_of_misses_holds_for_every_window():
    r = random.Random(5)
    repeated = [(100 + k, " ".join([r.choice(VOCABULARY) for _ in range(n)] * 4)) for k, n in enumerate((7, 10, 12, 15))]
    index = leaks.Index.build([*ITEMS, *repeated])
    exact = {w for ws in getattr(index, "direct", {}).values() for w in ws}
    for w, keys in enumerate(index.window_keys):
        for size, rounds in index.rounds.items():
            least = leaks.LEAST_CONTAINED / (size / len(keys) + 1 - leaks.LEAST_CONTAINED)
            assert w in exact or (1 - least) ** rounds <= leaks.MISS
    assert all(i in {x for x, _ in index.search(f"{item(900)} {t} {item(901)}")} for i, t in repeated)


def test_tags_of_any_length():
    w = ITEMS[3][1].split()[10:40]
    tag = '<span class="' + "x" * 268 + '">'
    texts = [item(910) + " " + f" {tag} ".join(w), f"<p {'data-a=1 ' * 90}>" + " ".join(w) + "</p>", item(911) + " if a <b and then " + " ".join(w) + " and c > d " + item(912)]
    assert [3 in h for h in found(texts)] == [True] * 3


def test_alignment_is_that_of_all_cells():
    def brute(passage, own):
        best, rows = (0, 0, 0, 0), [[(0, 0, j) for j in range(len(own) + 1)]]
        for w in passage:
            row = [(0, 0, 0)]
            for j in range(1, len(own) + 1):
                d, u, left = rows[-1][j - 1], rows[-1][j], row[j - 1]
                hit = (d[0] + 1, d[1] + 1, d[2]) if own[j - 1] == w else (d[0] - leaks.EDIT_COST, d[1], d[2])
                row.append(max(hit, (u[0] - leaks.EDIT_COST, u[1], u[2]), (left[0] - leaks.EDIT_COST, left[1], left[2]), (0, 0, j), key=lambda x: (x[0], x[1], -x[2])))
                if row[-1][0] > best[0]:
                    s, m, b = row[-1]
                    best = (s, m, (m - s) // leaks.EDIT_COST, j - b)
            rows.append(row)
        return best[1:]

    r = random.Random(21)
    for _ in range(150):
        b = [r.choice(VOCABULARY[:25]) for _ in range(r.randrange(3, 40))]
        a = [r.choice(VOCABULARY[:25]) for _ in range(5)] + scattered(b, min(len(b), r.randrange(5)), r) + [r.choice(VOCABULARY) for _ in range(5)]
        assert leaks.best_alignment(a, b) == brute(a, b)


def test_blocks_give_what_one_gives(spark):
    texts = [(k, f"{item(920 + k, 40)} {' '.join(ITEMS[k % 30][1].split()[5:35])} {item(960 + k, 40)}") for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    held = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = lambda block: sorted(map(tuple, leaks.leaked_items(docs, held, block=block).collect()))
    assert rows(7) == rows(2_000) and len(rows(7)) == 40
