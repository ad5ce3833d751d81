"""Encoding against the reference implementation of the public vocabulary."""

import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

import base64  # noqa: E402

from pixloom.llm import tokens  # noqa: E402


@pytest.fixture(scope="module")
def both():
    raw = tokens.read_rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tokens.Vocabulary(raw), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  x", "Hello, world!", "I'll we've it's'll", "naïve café  ŒŒ", "日本語のテキスト。", "🙂👍🏽", "a" * 20_000, "ab" * 500 + "1234567890" * 50, "<|endoftext|>", "\u0000퟿￿", "\t\t x \r\n", "=-=-" * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(both, text):
    v, e = both
    assert v.encode(text) == e.encode_ordinary(text)


def test_every_token_is_its_own_encoding(both):
    v, _ = both
    assert all(v.read_back(v.extend(t)) == (i,) for i, t in list(v.token.items())[::23])


def test_random_texts_appends_and_edits(both):
    v, e = both
    r = random.Random(2)
    bits = ["'", "l", "ll", "'ve", " ", "  ", "\n", "é", "日本", "9", "12", "word", "Word", "-", "...", "🙂"]
    for _ in range(1500):
        old = "".join(r.choice(bits) for _ in range(r.randrange(60)))
        a = r.randint(0, len(old))
        new = old[:a] + "".join(r.choice(bits) for _ in range(r.randrange(4))) + old[a + r.randrange(5) :]
        more = "".join(r.choice(bits) for _ in range(5))
        known, table = v.table(old)
        assert known == e.encode_ordinary(old)
        ids, edited = v.edit(old, known, table, new)
        assert ids == e.encode_ordinary(new) and same(edited, v.table(new)[1])
        ids, longer = v.append(new, ids, edited, more)  # on the table that the edit left
        assert ids == e.encode_ordinary(new + more) and same(longer, v.table(new + more)[1])


def same(a, b):
    return a.size == b.size and a.starts.tolist() == b.starts.tolist() and a.counts.tolist() == b.counts.tolist() and a.long == b.long


def test_long_pieces_and_their_tables(both):
    v, e = both
    r = random.Random(4)
    for _ in range(60):
        old = "".join(r.choice(["unbroken", "zzq", "日本", "a", " b "]) for _ in range(r.randrange(20, 120)))
        a = r.randrange(len(old))
        new = old[:a] + r.choice(["", "x", " ", "xyzzy" * 20]) + old[a + r.randrange(9) :]
        ids, table = v.edit(old, *v.table(old), new)
        assert ids == e.encode_ordinary(new) and same(table, v.table(new)[1])
        ids, table = v.append(new, ids, table, "unbrokenzz")
        assert ids == e.encode_ordinary(new + "unbrokenzz") and same(table, v.table(new + "unbrokenzz")[1])


def test_changes_of_long_texts_cost_little(both):
    import time

    v, e = both
    text = "".join(f"Line {i}: the lantern by the harbour was lit again.\n" for i in range(12_000))
    ids, table = v.table(text)

    def took(f):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            out = f()
            best = min(best, time.perf_counter() - began)
        return best, out

    whole, _ = took(lambda: v.encode(text))
    appended, (got, _) = took(lambda: v.append(text, ids, table, " and so on"))
    assert got == e.encode_ordinary(text + " and so on") and appended < whole / 3
    new = text[:300_000] + "changed" + text[300_004:]
    edited, (got, _) = took(lambda: v.edit(text, ids, table, new))
    assert got == e.encode_ordinary(new) and edited < whole / 3


def test_prefix_tables_continue(both):
    v, e = both
    text = ("unbroken" * 300 + "zzq" * 100).encode()
    table = v.extend(text[:1000])
    assert list(v.read_back(v.extend(text, table))) == e.encode_ordinary(text.decode())


def test_corpus(spark, both):
    _, e = both
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS[:8]])] + [(1, "", "again")]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), tokens.read_rank_file()).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, tuple(e.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), tokens.read_rank_file()).count() == 0


def test_changed_corpus(spark, both):
    _, e = both
    old = [(1, "one two three"), (2, None), (3, "gone"), (4, "日本語のテキスト"), (6, "unbroken" * 40)]
    new = [(1, "one two, three"), (2, "now"), (4, None), (5, "new text"), (6, "unbroken" * 20 + "x" + "unbroken" * 20)]
    raw = tokens.read_rank_file()
    schema = "doc_id bigint, text string"
    first = tokens.encode_with_tables(spark.createDataFrame(old, schema), raw).cache()
    assert {r.doc_id: r.ids for r in first.collect()} == {i: e.encode_ordinary(t or "") for i, t in old}
    second = tokens.reencode_corpus(first, spark.createDataFrame(new, schema), raw).cache()
    assert {r.doc_id: (r.text, r.ids) for r in second.collect()} == {i: (t or "", e.encode_ordinary(t or "")) for i, t in new}
    third = tokens.append_corpus(second, spark.createDataFrame([(1, "'s end"), (6, "unbroken"), (7, "x"), (2, None)], schema), raw).collect()
    assert {r.doc_id: r.ids for r in third} == {i: e.encode_ordinary(t) for i, t in ((1, "one two, three's end"), (6, new[4][1] + "unbroken"), (7, "x"), (2, "now"))}
