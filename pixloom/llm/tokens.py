"""Encoding a corpus with a public byte-level BPE tokenizer by prefix dynamic programming.

Every prefix of a byte string has one encoding, so it has one last token; a token that ends at a position is that last token
exactly if it may follow the last token of the prefix before it, that is if merging could not have joined across their border.
Storing the last token of every prefix gives the encoding in one pass over the bytes, in time proportional to their number
(merging by rank is quadratic in unbroken texts).

The tokenizer splits texts into pieces first, so a text's table is the places of its pieces, the tokens before each, and for long
pieces the last token of every prefix. With it an append reads the last few pieces again and continues the table of the last one,
and an edit reads from shortly before its first changed character to where pieces begin as before; all else is taken over.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.session import spread

# Fixed value: the pattern that splits text before merging, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Pieces before a border whose matching may have looked beyond it (two characters at most: 'll, and blanks before a word).
LOOKS_BACK = 3
CACHED_PIECES = 200_000
CACHED_PAIRS = 1_000_000
LONG_PIECE = 64


@dataclass
class PrefixTable:
    """What is kept of an encoded text: where its pieces begin (in characters), how many tokens come before each, and for pieces of
    LONG_PIECE bytes and more the last token of every prefix, by the piece's number."""

    size: int
    starts: np.ndarray
    counts: np.ndarray
    long: dict[int, list[int]] = field(default_factory=dict)


def _same_begin(a: str, b: str) -> int:
    """How many characters two texts have in common at their beginning, by comparing halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _same_end(a: str, b: str, most: int) -> int:
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


class Vocabulary:
    """The ranks of a byte-level BPE vocabulary, and the prefix tables of byte strings under it."""

    def __init__(self, rank_file: bytes, split: str = SPLIT):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(number) for token, number in lines}
        self.token = {number: token for token, number in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(split)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self.ends = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), number))
        self.ends.make_automaton()

    def parts(self, number: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if number not in self._parts:
            token = self.token[number]
            cut = [token[i : i + 1] for i in range(len(token))]
            while len(cut) > 2:
                merges = [(self.rank.get(cut[i] + cut[i + 1], number), i) for i in range(len(cut) - 1)]
                least, i = min(merges)
                if least >= number:
                    break
                cut[i : i + 2] = [cut[i] + cut[i + 1]]
            self._parts[number] = (self.rank[cut[0]], self.rank[cut[1]]) if len(cut) == 2 else None
        return self._parts[number]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge across their border comes up before each is complete.

        The border is walked back through the merges that made both sides, latest first; at each stage the pair that faced each
        other then must not have a rank below that of the merges that came later.
        """
        key = (left, right)
        known = self._follows.get(key)
        if known is not None:
            return known
        a, b, bound, apart = left, right, None, True
        while True:
            joined = self.rank.get(self.token[a] + self.token[b])
            if joined is not None and (bound is None or joined < bound):
                apart = False
                break
            # undo the later of the two merges; of one rank, the left one is made first, so the right one is undone first
            pa, pb = self.parts(a), self.parts(b)
            if pa is None and pb is None:
                break
            if pb is None or (pa is not None and a > b):
                bound, a = a, pa[1]
            else:
                bound, b = b + 1, pb[0]
        if len(self._follows) >= CACHED_PAIRS:
            self._follows.clear()
        self._follows[key] = apart
        return apart

    def extend(self, text: bytes, last: list[int] | None = None) -> list[int]:
        """last[i] is the last token of text[:i] (last[0] is -1); a table of a shorter prefix of text is continued, not redone."""
        known = 0 if last is None else len(last) - 1
        last = [-1] if last is None else last
        last.extend([-1] * (len(text) - known))
        begin = max(0, known - self.longest)
        for end, (size, number) in self.ends.iter(text[begin:].decode("latin-1")):
            at = begin + end + 1
            if at <= known or last[at] >= 0:
                continue
            start = at - size
            if start == 0 or (last[start] >= 0 and self.follows(last[start], number)):
                last[at] = number
        return last

    def read_back(self, last: list[int]) -> tuple[int, ...]:
        """The encoding of the whole text of a prefix table."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return tuple(reversed(out))

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self._pieces.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.rank.get(raw)
            found = (whole,) if whole is not None else self.read_back(self.extend(raw))
            if len(self._pieces) >= CACHED_PIECES:
                self._pieces.clear()
            self._pieces[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; an empty list for an empty or null one."""
        if not text:
            return []
        known, out = self._pieces, []
        for piece in self.split.findall(text):
            out.extend(known.get(piece) or self.piece(piece))
        return out

    def table(self, text: str | None) -> tuple[list[int], PrefixTable]:
        """(the ids of a text, its table)."""
        return self._join([], PrefixTable(0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), 0, text or "", 0, None)

    def append(self, tail: str, ids: list[int], table: PrefixTable, more: str) -> tuple[list[int], PrefixTable]:
        """(ids, table) of a text with more behind it, given its ids and table. tail: at least its last LOOKS_BACK pieces; the rest of
        the text is not needed."""
        keep = max(0, len(table.starts) - LOOKS_BACK)
        at = int(table.starts[keep]) if keep else 0
        return self._join(ids, table, keep, tail[len(tail) - (table.size - at) :] + more, at, None)

    def edit(self, old: str, ids: list[int], table: PrefixTable, new: str) -> tuple[list[int], PrefixTable]:
        """(ids, table) of new, given those of old: pieces before and after the changed characters are taken over."""
        same = _same_begin(old, new)
        keep = max(0, int(np.searchsorted(table.starts, same)) - LOOKS_BACK)
        at = int(table.starts[keep]) if keep else 0
        tail = _same_end(old, new, min(len(old), len(new)) - same)
        return self._join(ids, table, keep, new[at:], at, (len(old) - tail, len(new) - len(old)))

    def _join(self, ids: list[int], table: PrefixTable, keep: int, text: str, at: int, rest: tuple[int, int] | None) -> tuple[list[int], PrefixTable]:
        """The first `keep` pieces of a table, then those of text, which begins at character `at`; rest = (end of the change in the old
        text, by how many characters what follows has moved): from a piece on that begins as an old one did behind the change, the old ones."""
        before = int(table.counts[keep]) if keep < len(table.counts) else len(ids)
        out, starts, counts = ids[:before], [], []
        long = {k: v for k, v in table.long.items() if k < keep}
        again = len(table.starts)
        for m in self.split.finditer(text):
            start = at + m.start()
            if rest is not None and start - rest[1] > rest[0]:
                found = int(np.searchsorted(table.starts, start - rest[1]))
                if found < len(table.starts) and table.starts[found] == start - rest[1]:
                    again = found
                    break
            number = keep + len(starts)
            starts.append(start)
            counts.append(len(out))
            piece = m.group()
            if len(piece) < LONG_PIECE // 4 or len(raw := piece.encode("utf-8", "replace")) < LONG_PIECE:
                out.extend(self.piece(piece))
                continue
            # a long piece that goes on, or has a change in it, continues the old table up to there
            old = table.long.get(number) if number < len(table.starts) and table.starts[number] == start else None
            known = None if old is None else old[: self._common(old, raw, start, rest)]
            long[number] = self.extend(raw, known or None)
            out.extend(self.read_back(long[number]))
        shift = 0 if rest is None else rest[1]
        moved = keep + len(starts) - again
        if again < len(table.starts):
            counts_again = table.counts[again:] + (len(out) - int(table.counts[again]))
            out = out + ids[int(table.counts[again]) :]
        else:
            counts_again = table.counts[:0]
        long.update({k + moved: v for k, v in table.long.items() if k >= again})
        made = PrefixTable(
            at + len(text),
            np.concatenate([table.starts[:keep], np.array(starts, dtype=np.int64), table.starts[again:] + shift]),
            np.concatenate([table.counts[:keep], np.array(counts, dtype=np.int64), counts_again]),
            long,
        )
        return out, made

    def _common(self, last: list[int], raw: bytes, start: int, rest: tuple[int, int] | None) -> int:
        """How many entries of a piece's old table hold for its new bytes: those of the prefix that both have."""
        held = b"".join(self.token[t] for t in self.read_back(last))
        low, high = 0, min(len(held), len(raw))
        while low < high:
            middle = (low + high + 1) // 2
            if held[low:middle] == raw[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low + 1


_LOADED: dict[str, Vocabulary] = {}


def _loaded(rank_file: bytes) -> Vocabulary:
    """One vocabulary per Python worker, whatever the number of batches."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(rank_file)
    return _LOADED[key]


def encode_corpus(docs: DataFrame, rank_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>): the ids of every text, without special tokens; an empty list for empty and null texts.

    A map over the rows, without shuffle (but of tables of fewer partitions than cores); the vocabulary (below a megabyte, its size does not depend on the data) is broadcast.
    Blank texts are texts. Repeated ids and texts are encoded as often as they occur. Other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _loaded(ranks.value)
        for texts in batches:
            yield texts.map(vocabulary.encode, na_action=None)

    return spread(docs.select(id_col, text_col)).select(id_col, ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


TABLE = "size bigint, starts array<bigint>, counts array<bigint>, long array<struct<piece:bigint,last:array<int>>>"


def _stored(t: PrefixTable) -> dict:
    return {"size": t.size, "starts": t.starts, "counts": t.counts, "long": [{"piece": k, "last": v} for k, v in sorted(t.long.items())]}


def _restored(row: dict) -> PrefixTable:
    return PrefixTable(int(row["size"]), np.array(row["starts"], dtype=np.int64), np.array(row["counts"], dtype=np.int64), {int(x["piece"]): list(x["last"]) for x in row["long"]})


def encode_with_tables(docs: DataFrame, rank_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids, table) of every text: what reencode_corpus and append_corpus need later. Nulls count as empty texts."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)

    @F.pandas_udf(f"ids array<int>, table struct<{TABLE}>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = _loaded(ranks.value)
        for texts in batches:
            both = [vocabulary.table(t) for t in texts]
            yield pd.DataFrame({"ids": [i for i, _ in both], "table": [_stored(t) for _, t in both]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return spread(docs.select(id_col, text_col)).select(id_col, text.alias(text_col), encoded(text).alias("_e")).select(id_col, text_col, "_e.ids", "_e.table")


def reencode_corpus(encoded: DataFrame, changed: DataFrame, rank_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids, table) of changed(id, text), given encoded (from encode_with_tables or this) of earlier versions: only what lies
    near a change is encoded again.

    Ids of changed that encoded does not hold are encoded whole; ids that only encoded holds are not returned. id_col must be
    unique in both. Other columns are ignored.
    """
    return _continued(encoded, changed, rank_file, id_col, text_col, False)


def append_corpus(encoded: DataFrame, more: DataFrame, rank_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for more(id, text), texts that come behind those of encoded: only the last pieces of the old text are read."""
    return _continued(encoded, more, rank_file, id_col, text_col, True)


def _continued(encoded: DataFrame, news: DataFrame, rank_file: bytes, id_col: str, text_col: str, append: bool) -> DataFrame:
    ranks = news.sparkSession.sparkContext.broadcast(rank_file)
    old = encoded.select(id_col, F.col(text_col).alias("_old"), F.col("ids").alias("_ids"), F.col("table").alias("_table"))

    def one(vocabulary: Vocabulary, new: str, old: str | None, ids, table) -> tuple[str, list[int], PrefixTable]:  # noqa: ANN001
        if old is None:
            return new, *vocabulary.table(new)
        if append:
            return old + new, *vocabulary.append(old, list(ids), _restored(table), new)
        return new, *vocabulary.edit(old, list(ids), _restored(table), new)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _loaded(ranks.value)
        for b in batches:
            got = [one(vocabulary, *row) for row in zip(b["_new"], b["_old"], b["_ids"], b["_table"])]
            yield pd.DataFrame({id_col: b[id_col], text_col: [t for t, _, _ in got], "ids": [i for _, i, _ in got], "table": [_stored(t) for _, _, t in got]})

    both = news.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_new")).join(old, id_col, "left")
    key = both.schema[id_col].dataType.simpleString()
    return both.mapInPandas(work, f"`{id_col}` {key}, `{text_col}` string, ids array<int>, table struct<{TABLE}>")


def read_rank_file(path: str | None = None) -> bytes:
    """The vocabulary's rank file; by default byte_bpe_50k of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()
