"""Statistics and kinds of documents."""

import random

import numpy as np
import pytest

from pixloom.llm import boosting, quality, text_statistics, weak_labels

EN = "the of and to a in that is was for it with as on be at by this had not are but from or have an they which one you were all we her she there would their".split()
COMMON = {"en": frozenset(EN)}
NOUNS = "harbour lantern garden letter winter kitchen market window river story engine morning".split()


def prose(r, n=6):
    return " ".join(f"{r.choice(NOUNS).capitalize()} was in the {r.choice(NOUNS)} and {r.choice(['we', 'they', 'she'])} had a {r.choice(NOUNS)} with the {r.choice(NOUNS)}, but it was not from there." for _ in range(n))


def sample(kind, r):
    if kind == "prose":
        return prose(r, r.randrange(1, 8))
    if kind == "list":
        return "\n".join(f"{r.choice(['- ', '* ', '1. '])}{r.choice(NOUNS)} {r.choice(NOUNS)}" for _ in range(r.randrange(6, 30)))
    if kind == "table":
        mark = r.choice(["\t", ";", " | "])
        return "\n".join(mark.join([f"IMG_{r.randrange(9999)}.jpg", r.choice(NOUNS), f"20{r.randrange(10, 24)}-01-0{r.randrange(1, 9)}", str(r.randrange(999))]) for _ in range(r.randrange(5, 20)))
    return r.choice([
        "".join(r.choice("ABCDEFGHIJKLMNabcdefghijk0123456789+/") for _ in range(400)), " ".join(f"{r.randrange(256):02x}" for _ in range(150)), "share save print. " * 60,
        "".join(r.choice("~*=-#|/\\") for _ in range(300)), " ".join("".join(r.choice("bcdfgzxq") + r.choice("aeiouy") for _ in range(r.randrange(1, 4))) for _ in range(120)),
    ])


def test_statistics_of_plain_cases():
    lexicon = text_statistics.Lexicon(COMMON)
    of = lambda *texts: text_statistics.statistics(list(texts), lexicon)
    at = text_statistics.STATISTICS.index
    s = of("The cat was in the garden. It had not been there!\nWe were all at home.")[0]
    assert s[at("line_end_share")] == 1.0 and s[at("common_share")] > 0.5 and s[at("words")] == np.log1p(16) and s[at("in_common_lines")] > 0.5
    assert of("a\n" * 5)[0, at("lines")] == np.log1p(5)
    assert of("- one thing\n2. two\n[x] three\nfour")[0, at("bullet_share")] == 0.75
    assert of("see IMG_1.JPG, b.mp4 and e.g. this")[0, at("file_rate")] == 2 / 10  # see IMG 1 JPG b mp4 and e g this
    assert of("IMG\tParis\t2020\n" * 3)[0, at("in_fields")] == 1.0 and of("Name: value\nSize: 3")[0, at("pair_share")] == 1.0
    assert of("0a ff 12 e4 77 90 ab")[0, at("hex_share")] == 1.0 and of("<tr><td>x</td><td>y</td></tr>")[0, at("in_cells")] == 1.0
    assert of("one two three four five six " * 9)[0, at("repeated_phrase_share")] == 1.0
    odd = ["x", "....", "\n", "日本語", "a" * 300_000, "1", "\u0000", "|||", "", " ", "\ud800", "\r\n\r", "\u2028x"]
    assert np.isfinite(of(*odd)).all() and not of("", " \n ").any()


def test_texts_do_not_touch_each_other():
    r = random.Random(7)
    texts = [sample(r.choice(["prose", "list", "table", "junk"]), r) + r.choice(["", "\n", "-", " "]) for _ in range(60)] + ["", "x" * 500_000, "写真を撮った。" * 30]
    lexicon = text_statistics.Lexicon(COMMON)
    together = text_statistics.statistics(texts, lexicon)
    assert np.allclose(together, np.concatenate([text_statistics.statistics([t], lexicon) for t in texts]))


def test_counts_against_single_strings():
    r = random.Random(8)
    texts = [sample(r.choice(["prose", "list", "table", "junk"]), r) for _ in range(80)]
    found = text_statistics.statistics(texts, text_statistics.Lexicon(COMMON))
    at = text_statistics.STATISTICS.index
    for t, s in zip(texts, found):
        words = [w.lower() for w in weak_labels.WORD.findall(t)]
        lines = [x for x in t.split("\n") if x.strip()]
        expected = {
            "words": np.log1p(len(words)), "mean_word_length": sum(map(len, words)) / len(words) if words else 0, "common_share": weak_labels.known_share(words, COMMON), "lines": np.log1p(len(lines)),
            "digit_ratio": sum(map(str.isdigit, t)) / len(t), "space_ratio": sum(map(str.isspace, t)) / len(t), "distinct_share": len(set(words)) / max(1, len(words)),
            "repeated_phrase_share": weak_labels.repeated_share(words), "repeated_line_share": sum(lines.count(x) > 1 for x in lines) / len(lines),
        }
        assert {k: s[at(k)] for k in expected} == {k: pytest.approx(v) for k, v in expected.items()}


def test_weak_labels():
    r = random.Random(9)
    assert all(weak_labels.weak_label(sample(k, r), COMMON) in (k, None) for k in ("prose", "list", "table") for _ in range(20))
    assert [weak_labels.weak_label(t, COMMON) for t in (None, "", "  ", "perhaps")] == [None] * 4


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = np.where(x[:, 0] > 0.5, 1, np.where(x[:, 1] * x[:, 2] > 0, 2, 0))
    f = boosting.fit(x[:1000], y[:1000], 4)
    held = f.probabilities(x[1000:])
    assert (held.argmax(axis=1) == y[1000:]).mean() > 0.9 and np.allclose(held.sum(axis=1), 1) and held[:, 3].max() < 0.2
    noisy = np.where(rng.random(500) < 0.2, rng.integers(0, 3, 500), y[1000:])
    loss = lambda p: -np.log(p[np.arange(500), noisy]).mean()
    assert loss(boosting.calibrate(f, x[1000:], noisy).probabilities(x[1000:])) < loss(held)


def test_held_out_accuracy(spark):
    r = random.Random(1)
    truth = {i: r.choice(["prose", "prose", "list", "table", "junk"]) for i in range(500)}
    rows = [(i, sample(k, r), "x") for i, k in truth.items()] + [(1000, None, "x"), (1001, "", "x"), (1002, " \n ", "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    labels = spark.createDataFrame([(i, truth[i].title() if i % 2 else f" {truth[i]} ", "r1", None) for i in range(60)] + [(61, "bogus", "r1", None), (62, None, None, None)], "doc_id bigint, kind string, rater string, labelled_at timestamp")
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate(EN)] + [(None, None, None)], "lang string, word string, rank_no int")
    got = {(r.doc_id, r.kind) for r in quality.document_kinds(docs, labels, words).collect()}
    assert {(i, None) for i in (1000, 1001, 1002, 5)} <= got
    right = sum((i, truth[i]) in got for i in truth)
    assert right >= 0.97 * len(truth)
    none = quality.document_kinds(docs.limit(0), labels.limit(0), words)
    assert none.count() == 0 and "kind" in none.columns


def test_labels(spark):
    rows = [(1, "Prose", "a"), (1, "prose ", "b"), (1, "junk", "c"), (2, "list", "a"), (2, "table", "b"), (3, "nonsense", "a"), (4, "junk", None), (None, "junk", "a")]
    got = quality.clean_labels(spark.createDataFrame(rows, "doc_id bigint, kind string, rater string")).where("doc_id is not null").collect()
    assert {(r.doc_id, r.kind) for r in got} == {(1, "prose"), (4, "junk")}
