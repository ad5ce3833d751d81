"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified exactly.

Held-out items are cut into overlapping windows, the short sets that are searched for. A document enters as the set of its word
shingles that occur in any item at all: leaving out the others changes no window's containment and makes the sets small. (A word
is a number if any item has it, so of most shingles a look at the numbers shows that no item has them.) Long
documents are cut into overlapping passages of such shingles, so that a window lies whole in one passage, and passages fall into
partitions by their size. For each partition the least containment is turned into the least Jaccard similarity at its largest
size, and so many MinHash values are compared that a window so contained is missed with probability 1/400 at most. That holds
for windows of one size; those with fewer distinct shingles than the largest are found by each of their shingles. Candidates are
verified by exact containment of the window's shingles and then by aligning the words: enough of the item, in its order, with few
changed, dropped or added.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.session import remove_dir, spread, work_dir

SHINGLE = 3
WINDOW, STEP = 20, 5
LEAST_CONTAINED = 0.35
MISS = 1 / 400
SIZES = (16, 32, 64)
OVERLAP = 32
ITEM_BLOCK, BLOCK_CHARS = 2_000, 20_000_000
LEAST_WORDS = 20
EDIT_COST = 5
EDITS_PER_WORD = 1 / 7
WORDS_PER_EDIT = 8
EDGE = 16
FEWEST_MATCHED = min(LEAST_WORDS - LEAST_WORDS // WORDS_PER_EDIT, math.ceil(LEAST_WORDS * (1 - EDITS_PER_WORD)))

TAG_WORDS = 10

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt])")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_SPLIT_WORD = re.compile(r"(\w)[-‐‑]\s*\n[\s>]*(\w)")
_INSIDE = "'’‘`´ʼ"
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = regex.compile(r"[\p{Mn}\p{Cf}]+")
_IDEOGRAPH = re.compile(r"([぀-ヿ㐀-鿿豈-﫿])")


def _unescaped(text: str) -> str:
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "%20" in text:
        text = _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    return text


def _words(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        text = _IDEOGRAPH.sub(r" \1 ", text)
    if "\n" in text:
        text = _SPLIT_WORD.sub(r"\1-\2", text)
    text = text.casefold()
    for sign in _INSIDE:
        text = text.replace(sign, "")
    return _WORD.findall(text)


def plain_words(text: str) -> list[str]:
    """The words of a text however they are written, set or marked up: letter case, accents, markup (of any length), escapes,
    invisible characters, line breaks, quotation and apostrophes do not matter. Characters of scripts without blanks are words of
    their own."""
    text = _unescaped(text)
    return _words(_TAG.sub(" ", text) if "<" in text else text)


def readings(text: str) -> list[list[str]]:
    """The words of a text without its markup; and, where something of TAG_WORDS words or more was taken for a tag, which may be text
    between signs, also with that left in. What is found in either reading counts."""
    text = _unescaped(text)
    if "<" not in text:
        return [_words(text)]
    out = [_words(_TAG.sub(" ", text))]
    is_text = lambda tag: len(tag.split()) >= TAG_WORDS
    if any(is_text(m[0]) for m in _TAG.finditer(text)):
        out.append(_words(_TAG.sub(lambda m: m[0] if is_text(m[0]) else " ", text)))
    return out


def _spread_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def best_alignment(passage: list[str], item: list[str]) -> tuple[int, int, int]:
    """(matched, edits, item words spanned) of the stretch of the item that the passage reproduces best, in order.

    A match scores 1, an edit costs EDIT_COST. One row of all item words for each word of the passage; a cell is one number of score,
    matches and begin, from which the edits follow. Item words left out within a row are a running maximum with a slope.
    """
    n = len(item)
    field = max(n, len(passage)).bit_length() + 1
    one, match = 1 << (2 * field), (1 << (2 * field)) + (1 << field)
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    own = np.array([number[w] for w in item], dtype=np.int64)
    begin = (1 << field) - 1 - np.arange(n + 1, dtype=np.int64)  # a later begin is the smaller number
    slope = np.arange(n + 1, dtype=np.int64) * (EDIT_COST * one)
    before, best, at = begin.copy(), 0, 0
    hit = {i: np.where(own == i, match, -EDIT_COST * one) for i in set(own.tolist())}
    miss = np.full(n, -EDIT_COST * one)
    for word in passage:
        now = before - EDIT_COST * one  # added
        np.maximum(now[1:], before[:-1] + hit.get(number.get(word, -1), miss), out=now[1:])
        np.maximum(now, begin, out=now)
        now = np.maximum.accumulate(now + slope) - slope  # left out
        np.maximum(now, begin, out=now)
        top = int(now.argmax())
        if int(now[top]) >> (2 * field) > best >> (2 * field):
            best, at = int(now[top]), top
        before = now
    score, matched = best >> (2 * field), (best >> field) & ((1 << field) - 1)
    return matched, (matched - score) // EDIT_COST, at - ((1 << field) - 1 - (best & ((1 << field) - 1))) if best else 0


def longest_stretch(passage: list[str], item: list[str], most: int | None = None) -> int:
    """Most words matched in a stretch of LEAST_WORDS or more of the item that the passage has in order with one edit in
    WORDS_PER_EDIT words at most, wherever the edits lie; 0 if there is none. most: look for any stretch
    with so many edits at most, and stop at the first.

    Exact: for each number of edits, the longest stretch that ends at each pair of words. Cells lie by edits and by item word less
    edits, so that a word left out stays in its column and any run of them is one running maximum.
    """
    n = len(item)
    edits = n // WORDS_PER_EDIT if most is None else min(most, n // WORDS_PER_EDIT)
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    one = 1 << 24  # a value is the item words of a stretch times this, and those that match
    none = -(1 << 50)
    e, d = np.arange(edits + 1)[:, None], np.arange(-edits, n + 1)[None, :]
    at = d + e  # how many item words come before the end of the stretch
    inside = (at >= 0) & (at <= n)
    own = np.where((at >= 1) & (at <= n), np.array([number[w] for w in item] + [-1])[np.clip(at - 1, 0, n)], -1)
    least = np.maximum(LEAST_WORDS, WORDS_PER_EDIT * e) * one
    slope = e * one
    outside = np.where(inside, 0, none)
    hits = {i: np.where(own == i, one + 1, none)[:, 1:] for i in number.values()}
    start = np.where((e == 0) & inside, 0, none)
    before = np.where(inside & (at >= e), slope, none)
    best = 0
    for word in passage:
        now = start.copy()
        if word in number:
            np.maximum(now[:, 1:], before[:, :-1] + hits[number[word]], out=now[:, 1:])
        if edits:
            np.maximum(now[1:], before[:-1] + one, out=now[1:])  # changed
            np.maximum(now[1:, :-1], before[:-1, 1:], out=now[1:, :-1])  # added
            now = np.maximum.accumulate(now - slope, axis=0) + slope  # left out
            now += outside
        if int(now.max()) >= LEAST_WORDS * one:
            whole = now[now >= least]
            if whole.size:
                best = max(best, int((whole % one).max()))
                if most is not None:
                    return best
        before = now
    return best


def reproduces(passage: list[str], item: list[str]) -> tuple[bool, float]:
    """Whether a passage reproduces enough of the item with few edits, and the share of the item's words that it has.

    A stretch of twice LEAST_WORDS can be halved so that one half has no more edits a word than the whole, so whether there is
    any stretch shows at fewer than that many words already. What the best-scoring stretch has is enough too, as its ends are cut.
    """
    m, e, span = best_alignment(passage, item)
    leaks = span >= LEAST_WORDS and m >= LEAST_WORDS * (1 - EDITS_PER_WORD) and e <= max(1, math.ceil(span * EDITS_PER_WORD))
    if leaks and m == common(passage, item):
        return True, m / len(item)
    if leaks or longest_stretch(passage, item, (2 * LEAST_WORDS - 1) // WORDS_PER_EDIT):
        k = longest_stretch(passage, item)
        leaks, m = True, max(k, m) if leaks else k
    return leaks, m / max(1, len(item))


def common(passage: list[str], item: list[str]) -> int:
    """How many words they share in any order: no alignment can match more."""
    return (Counter(passage) & Counter(item)).total()


@dataclass
class Index:
    """Windows of one block of items, and for each MinHash function the windows by their least value."""

    words: dict[int, list[str]]
    number: dict[str, int]
    window_item: list[int]
    window_keys: list[frozenset[int]]
    universe: frozenset[int]
    tables: list[dict[int, list[int]]]
    multipliers: np.ndarray
    additions: np.ndarray
    rounds: dict[int, int]
    fewest: int
    direct: dict[int, list[int]]

    @classmethod
    def build(cls, items: list[tuple[int, str | None]]) -> Index:
        words = {i: w for i, t in items if len(w := plain_words(t or "")) >= SHINGLE}
        number: dict[str, int] = {}
        for own in words.values():
            for w in own:
                number.setdefault(w, len(number) + 1)
        window_item, window_keys = [], []
        for item, own in words.items():
            ids = [number[w] for w in own]
            last = max(0, len(own) - WINDOW)
            for at in sorted({*range(0, last, STEP), last}):
                window_item.append(item)
                window_keys.append(frozenset(_shingles(ids[at : at + WINDOW])))
        # least Jaccard similarity of a window of the largest size and a passage of the largest size of each partition
        most = max((len(k) for k in window_keys), default=1)
        rounds = {}
        for size in SIZES:
            least = LEAST_CONTAINED / (size / most + 1 - LEAST_CONTAINED)
            rounds[size] = math.ceil(math.log(MISS) / math.log(1 - least))
        functions = max(rounds.values())
        draw = np.random.default_rng(7)
        multipliers = draw.integers(1, 2**63, functions, dtype=np.uint64) | np.uint64(1)
        additions = draw.integers(0, 2**63, functions, dtype=np.uint64)
        out = cls(words, number, window_item, window_keys, frozenset().union(*window_keys), [defaultdict(list) for _ in range(functions)], multipliers, additions, rounds, 1, defaultdict(list))
        for w, keys in enumerate(window_keys):
            if len(keys) < most:
                for k in keys:
                    out.direct[k].append(w)
                continue
            for r, value in enumerate(out.signature(keys, functions)):
                out.tables[r][value].append(w)
        out.tables, out.direct = [dict(t) for t in out.tables], dict(out.direct)
        out.fewest = max(1, math.ceil(LEAST_CONTAINED * min((len(k) for k in window_keys), default=1)))
        return out

    def signature(self, keys: frozenset[int] | set[int], functions: int) -> list[int]:
        x = np.fromiter(keys, dtype=np.uint64, count=len(keys))[:, None]
        with np.errstate(over="ignore"):
            return _spread_bits(x * self.multipliers[:functions] + self.additions[:functions]).min(axis=0).tolist()

    def search(self, text: str) -> list[tuple[int, float]]:
        """(item, share of its words) for every item of the block that the text leaks."""
        return self.search_words(readings(text))

    def search_words(self, all_readings: list[list[str]]) -> list[tuple[int, float]]:
        """The same for texts that are words already, in one or more readings."""
        best: dict[int, float] = {}
        for words in all_readings:
            for item, share in self._search(words):
                best[item] = max(share, best.get(item, 0.0))
        return list(best.items())

    def _search(self, words: list[str]) -> list[tuple[int, float]]:
        known = self.number.get
        universe = self.universe
        ids = list(map(known, words))
        hits = [(i, k) for i, (a, b, c) in enumerate(zip(ids, ids[1:], ids[2:])) if a and b and c and (k := a << 42 | b << 21 | c) in universe]
        if len(hits) < self.fewest:
            return []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        largest = SIZES[-1]
        for at in range(0, max(1, len(hits) - OVERLAP), largest - OVERLAP):
            part = hits[at : at + largest]
            keys = {k for _, k in part}
            if len(keys) < self.fewest:
                continue
            functions = self.rounds[next(s for s in SIZES if len(keys) <= s)]
            candidates = set()
            for table, value in zip(self.tables, self.signature(keys, functions)):
                candidates.update(table.get(value, ()))
            for k in keys & self.direct.keys():
                candidates.update(self.direct[k])
            found = {self.window_item[w] for w in candidates if len(self.window_keys[w] & keys) >= LEAST_CONTAINED * len(self.window_keys[w])}
            for item in found:
                spans[item].append((part[0][0], part[-1][0] + SHINGLE))
        out = []
        for item, parts in spans.items():
            own, best = self.words[item], 0.0
            near = set(_shingles([self.number[w] for w in own]))
            for first, last in _stretches([i for i, k in hits if k in near and any(a <= i < b for a, b in parts)], len(own)):
                part = words[max(0, first - EDGE) : last + EDGE]
                if common(part, own) < FEWEST_MATCHED:
                    continue
                leaks, share = reproduces(part, own)
                if leaks:
                    best = max(best, share)
            if best:
                out.append((item, best))
        return out


def _shingles(ids: list[int]) -> Iterator[int]:
    """One number for each three words, exact for blocks of items of up to 2^21 distinct words."""
    return (a << 42 | b << 21 | c for a, b, c in zip(ids, ids[1:], ids[2:]))


def _stretches(places: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Runs of places that are closer than the allowed edits could tear a passage; only such a run can be one passage."""
    begin = before = None
    count = 0
    for at in places:
        if before is not None and at - before > 3 * SHINGLE + 8:
            if count >= 2:
                yield begin, before + SHINGLE
            begin, count = None, 0
        begin = at if begin is None else begin
        before, count = at, count + 1
    if begin is not None and count >= 2:
        yield begin, before + SHINGLE


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = ITEM_BLOCK) -> DataFrame:
    """(id, item, share): each document with each item it leaks, and the greatest share of the item's words in one passage.

    A document leaks an item if a passage reproduces LEAST_WORDS (20) or more of its words in order with at most one in seven of
    them changed, dropped or added (one in eight wherever they lie, and one more for a passage whose ends are whole). Null and empty texts leak nothing, items
    of fewer than 20 words cannot be leaked; a document that occurs twice gives its rows once; rows without id are ignored, and so are
    other columns.

    Whole texts of all documents are searched. A block of items (about 2,000, 20 million characters) is what is sent to the tasks; if
    there are more, texts are turned into words once, blocks run one after another, and each is forgotten before the next is read, so
    neither driver nor tasks hold more than one. No shuffle but the last one over the few leaks.
    """
    spark = docs.sparkSession
    held = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    size = held.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / block), math.ceil(size[1] / BLOCK_CHARS))
    texts = spread(docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(id_col, text_col))
    schema = f"`{id_col}` bigint, `{item_col}` bigint, share double"
    if blocks == 1:
        index = spark.sparkContext.broadcast(Index.build([(r.i, r.t) for r in held.collect()]))
        found = texts.mapInPandas(_searcher(index, id_col, item_col), schema)
    else:
        where = work_dir(spark, "leaks")
        texts.select(id_col, _as_words(F.col(text_col)).alias("words")).write.parquet(f"{where}/words")
        words = spark.read.parquet(f"{where}/words")
        for b in range(blocks):
            mine = held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
            index = spark.sparkContext.broadcast(Index.build([(r.i, r.t) for r in mine]))
            words.mapInPandas(_searcher(index, id_col, item_col, True), schema).write.parquet(f"{where}/{b}")
            index.destroy()
        remove_dir(spark, f"{where}/words")
        found = spark.read.schema(schema).parquet(*[f"{where}/{b}" for b in range(blocks)])
    return found.groupBy(id_col, item_col).agg(F.max("share").alias("share"))


def _as_words(text):  # noqa: ANN001, ANN202 - Column -> Column
    """The readings of each text, words between blanks."""

    @F.pandas_udf("array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [" ".join(words) for words in readings(t)])

    return read(text)


def _searcher(index, id_col: str, item_col: str, as_words: bool = False):  # noqa: ANN001, ANN202 - a broadcast, and a function for mapInPandas
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = (lambda t: index.value.search_words([r.split(" ") for r in t])) if as_words else index.value.search
        for batch in batches:
            rows = [(d, i, s) for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) for i, s in of(t)]
            yield pd.DataFrame(rows, columns=[id_col, item_col, "share"]).astype({id_col: "int64", item_col: "int64", "share": "float64"})

    return search
