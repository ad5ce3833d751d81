"""Statistics of many texts at once: every character, word and line of a block of texts is looked at in array operations.

A block is one array of code points. Character classes come from a table that is filled as code points are met; words, tokens and
lines are runs of classes; words are compared by a hash that is read off running sums, so no string is cut out of a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from pixloom.llm.weak_labels import MENU_WORDS

STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share",
    "chars", "lines", "digit_ratio", "upper_ratio", "space_ratio", "letter_ratio", "kana_ratio", "cjk_ratio", "vowel_ratio",
    "longest_word", "long_word_share", "distinct_share", "top_word_share", "packed_ratio", "repeated_line_share", "repeated_phrase_share",
    "line_words", "short_line_share", "bullet_share", "tab_rate", "pipe_rate", "semicolon_rate", "comma_rate", "gap_rate", "cell_rate",
    "pair_share", "file_rate", "tag_rate", "odd_letter_ratio", "broken_word_share", "hex_share", "menu_share", "capital_share",
    # shares of the characters that lie in lines of some layout
    "in_long_lines", "in_common_lines", "in_uncommon_lines", "in_ended_lines", "in_continued_lines", "in_short_lines", "in_bullets", "in_pairs", "in_fields", "in_cells",
    "in_file_lines", "in_tag_lines", "in_comma_lists", "in_mark_lists", "in_tight_fields", "in_odd_lines", "in_hex_lines", "in_number_lines", "in_long_tokens", "in_menus",
    "in_symbol_lines", "in_broken_lines", "in_ideographs", "in_capital_lines", "in_repeated_lines",
)

# Endings of file names, and what marks rows of markup tables.
FILE_ENDINGS = ("jpg", "jpeg", "png", "gif", "heic", "webp", "mp4", "mov", "avi", "raw", "dng", "tif", "tiff", "pdf", "doc", "docx", "txt", "zip", "json", "csv")
CELLS = ("td", "th", "tr")
# Characters by what they do.
BULLETS = "-–—*•·‣◦▪●○☐☑✓✔✗>+"
ENDS = ".!?…。！？"
CLOSERS = "\"'”»)]"
INSIDE_WORDS = "'’-"
VOWELS = "aeiouyáàâäéèêëíìîïóòôöúùûüåæøœ"
ODD = "ŒœŠšŸŽžƒˆ˜…‰€™≈≠≤≥√ⁿ⌐�"
ODD_LEADS = "ÃÂâãäåæçèéï"
PLAIN_INSIDE = "'’.-/&@,:·#*_=+%()\"“”„«»!?;…<>|"
BREAKS_WORD = "!|;(){}[]~^»«_0123456789"

LETTER, DIGIT, UPPER, LOWER, SPACE, ALNUM, KANA, CJK, LATIN, VOWEL, ODD_SIGN, ODD_LEAD, BULLET, END, CLOSER, HEX, STRANGE, SPLITS = (1 << i for i in range(18))
BLOCK_CHARS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Characters:
    """The classes and lower case of code points, filled as they are met."""

    def __init__(self) -> None:
        self.classes = np.zeros(0x110000, dtype=np.uint32)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.met = np.zeros(0x110000, dtype=bool)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def learn(self, codes: np.ndarray) -> None:
        there = np.zeros(0x110000, dtype=bool)
        there[codes] = True
        for code in np.flatnonzero(there & ~self.met):
            c = chr(code)
            low = c.lower()
            plain = c.isalnum() or c.isspace() or c in PLAIN_INSIDE
            bits = (
                (c.isalpha(), LETTER), (c.isdigit(), DIGIT), (c.isupper(), UPPER), ("a" <= c <= "z" or "à" <= c <= "ÿ", LOWER), (c.isspace(), SPACE), (c.isalnum(), ALNUM),
                ("぀" <= c <= "ヿ", KANA), ("㐀" <= c <= "鿿" or "豈" <= c <= "﫿", CJK), ("a" <= low <= "z" or "À" <= c <= "ɏ", LATIN), (low in VOWELS, VOWEL),
                ("\u0080" <= c <= "¿" or c in ODD or "†" <= c <= "•" or "─" <= c <= "▟" or "α" <= low <= "ω", ODD_SIGN), (c in ODD_LEADS, ODD_LEAD), (c in BULLETS, BULLET), (c in ENDS, END),
                (c in CLOSERS, CLOSER), (c in "0123456789abcdefABCDEF", HEX), (not plain, STRANGE), (c in BREAKS_WORD, SPLITS),
            )
            self.classes[code] = sum(bit for has, bit in bits if has)
            self.lower[code] = ord(low[0])
            self.met[code] = True

    def grow(self, n: int) -> None:
        if len(self.powers) <= n:
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + 1, _BASE, dtype=np.uint64))])
                self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + 1, _INVERSE, dtype=np.uint64))])


_TABLE: list[_Characters] = []


def _table() -> _Characters:
    if not _TABLE:
        _TABLE.append(_Characters())
    return _TABLE[0]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Hashes:
    """Hashes of stretches of a block in lower case; equal stretches have equal hashes wherever they are."""

    def __init__(self, codes: np.ndarray) -> None:
        t = _table()
        t.grow(len(codes))
        with np.errstate(over="ignore"):
            terms = (t.lower[codes].astype(np.uint64) + np.uint64(1)) * t.powers[: len(codes)]
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        self.inverses = t.inverses

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for single words."""
    out = np.zeros(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        codes = _codes(w)
        _table().learn(codes)
        out[i] = _Hashes(codes).of(np.zeros(1, dtype=np.int64), np.full(1, len(codes)))[0]
    return out


class Lexicon:
    """The common words of each language, and those of page furniture, by their hashes."""

    def __init__(self, common: dict[str, frozenset[str]]) -> None:
        self.languages = max(1, len(common))
        words = sorted({w for own in common.values() for w in own} | MENU_WORDS)
        hashes = hash_words(words)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        flags = np.zeros((len(words) + 1, self.languages + 1), dtype=bool)
        flags[:-1] = [[*(w in own for own in common.values()), *([False] if not common else []), w in MENU_WORDS] for w in (words[i] for i in order)]
        self.flags = flags  # the last row is of unknown words, the last column of furniture
        self.files, self.cells = np.sort(hash_words(list(FILE_ENDINGS))), np.sort(hash_words(list(CELLS)))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.flags[np.where(self.hashes[at] == hashes, at, len(self.hashes))]


def _within(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return sorted_values[at] == asked


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a mask begin and end."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _times(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each value occurs with its owner, whether it is the first of its kind there)."""
    if not len(value):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    run = np.cumsum(new) - 1
    times, first = np.empty(len(value), dtype=np.int64), np.empty(len(value), dtype=bool)
    times[order], first[order] = np.bincount(run)[run], new
    return times, first


def _repeated(owner: np.ndarray, item: np.ndarray, docs: int) -> np.ndarray:
    """For each document the share of its items within phrases of six that occur three times or more (fewer of fewer than 18)."""
    n = np.bincount(owner, minlength=docs)
    inside = np.zeros(docs)
    span_of = np.where(n < 9, 0, np.minimum(6, n // 3))
    for span in np.unique(span_of[span_of > 0]):
        mine = span_of[owner] == span
        own, its = owner[mine], item[mine]
        last = len(its) - span + 1
        phrase = np.zeros(last, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(span):
                phrase = phrase * _BASE + its[k : last + k]
        whole = np.flatnonzero(own[:last] == own[span - 1 :])
        times, _ = _times(own[whole], phrase[whole])
        begin = whole[times >= 3]
        steps = np.zeros(len(its) + 1, dtype=np.int32)
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + span, -1)
        inside += np.bincount(own[np.cumsum(steps[:-1]) > 0], minlength=docs)
    return inside / np.maximum(1, n)


def _block(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    d = len(texts)
    c = _codes("\n".join(texts) + "\n")
    size = np.array([len(t) for t in texts], dtype=np.int64)
    t = _table()
    t.learn(c)
    k = t.classes[c]
    n = len(c)
    nxt, prv = np.concatenate([c[1:], [10]]), np.concatenate([[10], c[:-1]])
    kn, kp = np.concatenate([k[1:], [SPACE]]).astype(np.uint32), np.concatenate([[SPACE], k[:-1]]).astype(np.uint32)
    has = lambda bits: (k & np.uint32(bits)) != 0
    char_doc = np.repeat(np.arange(d), size + 1)
    solid = ~has(SPACE)

    # lines: what lies between breaks and is not blank
    broken = (c == 10) | (c == 13)
    all_lines = np.cumsum(broken) - broken
    filled = np.bincount(all_lines[solid], minlength=all_lines[-1] + 1) > 0
    number = np.cumsum(filled) - 1
    lines = int(filled.sum())
    line = np.where(filled[all_lines], number[all_lines], lines)  # characters of blank lines belong to none
    line[broken] = lines
    at_solid = np.flatnonzero(solid)
    edges = np.flatnonzero(np.diff(line[at_solid], prepend=-1)) if len(at_solid) else np.zeros(0, dtype=np.int64)
    first = at_solid[edges]
    last = at_solid[np.concatenate([edges[1:], [len(at_solid)]]) - 1] if lines else first
    line_doc = char_doc[first]
    per_line = lambda mask: np.bincount(line[mask], minlength=lines + 1)[:lines]
    line_size = np.maximum(1, per_line(~broken))
    line_solid = np.maximum(1, per_line(solid))

    # words and tokens
    joins = np.isin(c, _codes(INSIDE_WORDS)) & ((kp & ALNUM) != 0) & ((kn & ALNUM) != 0)
    begin, end = _runs(has(ALNUM) | joins)
    hashes = _Hashes(c)
    word = hashes.of(begin, end)
    word_doc, word_line, word_size = char_doc[begin], line[begin], end - begin
    flags = lexicon.look_up(word)
    in_line = lambda mask: np.bincount(word_line[mask], minlength=lines + 1)[:lines]
    line_words = in_line(slice(None))
    by_language = np.stack([in_line(flags[:, i]) for i in range(lexicon.languages)], axis=1)
    line_known = by_language.max(axis=1, initial=0) / np.maximum(1, line_words)
    menu_line = in_line(flags[:, -1])
    token_begin, token_end = _runs(solid)
    token_line, token_size = line[token_begin], token_end - token_begin
    token_hex = np.add.reduceat(has(HEX), token_begin) if len(token_begin) else np.zeros(0)
    token_digit = np.add.reduceat(has(DIGIT), token_begin) if len(token_begin) else np.zeros(0)
    # reduceat runs on to the next token; what lies between them is blank and counts nothing
    of_hex = (token_hex == token_size) & ((token_size == 2) | (token_size >= 6))
    in_tokens = lambda mask: np.bincount(token_line[mask], minlength=lines + 1)[:lines]
    tokens = in_tokens(slice(None))

    # signs
    word_at = np.full(n + 2, -1, dtype=np.int64)
    word_at[begin] = np.arange(len(begin))

    def followed(where: np.ndarray, by: np.ndarray) -> np.ndarray:
        w = word_at[where + 1]
        return where[(w >= 0) & _within(by, word[np.maximum(w, 0)])] if len(word) else where[:0]

    one = lambda sign: c == ord(sign)
    marks = lambda where: np.bincount(line[where], minlength=lines + 1)[:lines]
    dots = np.flatnonzero(one(".") & ((kp & ALNUM) != 0))
    files = marks(followed(dots, lexicon.files))
    opened = np.flatnonzero(one("<"))
    closing = opened[nxt[opened] == 47] + 1
    cells = marks(np.concatenate([followed(opened, lexicon.cells), followed(closing, lexicon.cells)]))
    tags = marks(np.flatnonzero(one("#") & ((kp & SPACE) != 0) & ((kn & ALNUM) != 0)))
    tabs, pipes, semicolons, commas = (marks(np.flatnonzero(one(s))) for s in "\t|;,")
    slashes = marks(np.flatnonzero(one("/") | one("·") | one("•") | (one("-") & (prv == 32) & (nxt == 32))))
    gap = np.flatnonzero(one(" ") & (nxt == 32) & ((kp & SPACE) == 0))
    gap = gap[line[gap] < lines]
    gaps = marks(gap[gap < last[line[gap]]]) if lines else marks(gap)
    odd = per_line(has(ODD_SIGN)) + per_line(has(ODD_LEAD) & (((kn & ODD_SIGN) != 0) | np.isin(nxt, _codes("–—‘’‚“”„"))))
    between = ((kp & LETTER) != 0) & ((kn & LETTER) != 0)
    crooked = ((kp & LOWER) != 0) & ((kn & LOWER) != 0) & (((c >= 65) & (c <= 90)) | (c == 48) | (c == 49))
    broken_words = per_line(between & has(STRANGE | SPLITS) | crooked)

    # layout of lines
    if lines:
        at = lambda where: k[np.minimum(where, n - 1)]
        sign = lambda where: c[np.minimum(where, n - 1)]
        spaced = lambda where: (at(where) & SPACE) != 0
        bulleted = ((at(first) & BULLET) != 0) & spaced(first + 1)
        lead = first + (sign(first) == ord("("))
        for digits in (1, 2, 3):
            run = np.logical_and.reduce([(at(lead + i) & DIGIT) != 0 for i in range(digits)])
            bulleted |= run & np.isin(sign(lead + digits), (ord("."), ord(")"))) & spaced(lead + digits + 1)
        bulleted |= ((at(lead) & LETTER) != 0) & np.isin(sign(lead + 1), (ord("."), ord(")"))) & spaced(lead + 2)
        bulleted |= (sign(first) == ord("[")) & ((sign(first + 1) == ord("]")) | (sign(first + 2) == ord("]")))
        bulleted &= last > first + 2
        ended = ((at(last) & END) != 0) | (((at(last) & CLOSER) != 0) & ((at(last - 1) & (END | CLOSER)) != 0) & (last > first))
        comma_end = np.isin(sign(last), _codes(",;:"))
        colon = np.full(lines + 1, n, dtype=np.int64)
        named = np.flatnonzero((one(":") & ((kn & SPACE) != 0)) | one("="))[::-1]
        colon[line[named]] = named
        colon = colon[:lines]
        exclaims = per_line(one("!") | one("?") | one("。"))
        # a name of few characters, a sign, and a value of few: what name-value rows look like
        pair = (colon < last) & ((at(first) & LETTER) != 0) & (colon - first <= 32) & (last - colon <= 43) & (exclaims == 0) & (line_words <= 8)
        # a line that goes on in the next one of its text
        follows = np.zeros(lines, dtype=bool)
        follows[1:] = ((at(first[1:]) & LOWER) != 0) & ~ended[:-1] & ~comma_end[:-1] & (line_size[:-1] > 24) & (line_doc[1:] == line_doc[:-1])
        continued = follows.copy()
        continued[:-1] |= follows[1:]
    else:
        bulleted = ended = pair = continued = np.zeros(0, dtype=bool)
    few = lambda parts, words: line_words <= words * parts
    letters, digits = per_line(has(LETTER)), per_line(has(DIGIT))
    ideographs = per_line(has(KANA | CJK))
    capitals_at = in_line((k[begin] & UPPER) != 0)
    line_hash = hashes.of(first, last + 1)
    line_times, _ = _times(line_doc, line_hash)
    longest_token = np.zeros(lines + 1, dtype=np.int64)
    np.maximum.at(longest_token, token_line, token_size)
    longest_token = longest_token[:lines]
    comma_space = per_line(one(",") & (nxt == 32)) + per_line(one(";") & (nxt == 32))
    cjk_line = ideographs > 0.3 * line_solid
    fields = np.maximum.reduce([tabs, pipes, gaps, semicolons * (semicolons >= 2)])
    layouts = [
        line_words >= 6,
        (line_words >= 6) & (line_known >= 0.2),
        (line_words >= 8) & (line_known < 0.13) & (digits == 0),
        ended & (line_words >= 4),
        continued,
        (line_words <= 6) & ~ended & ~cjk_line,
        bulleted,
        pair & (line_known < 0.3),
        (fields >= 2) & few(fields + 1, 3.5) & (line_known < 0.3),
        cells >= 3,
        files > 0,
        (tags >= 3) & (tags > 0.4 * line_words),
        (commas >= 4) & few(commas + 1, 2.2) & (line_known < 0.25),
        (slashes + semicolons >= 4) & few(slashes + semicolons + 1, 2.2) & (line_known < 0.25),
        (commas + semicolons >= 2) & (comma_space == 0) & (line_known < 0.3),
        (odd >= 3) & (odd > 0.12 * line_size),
        (tokens >= 6) & (in_tokens(of_hex) >= 0.7 * tokens),
        (tokens >= 6) & (in_tokens(token_digit == token_size) >= 0.9 * tokens),
        (longest_token >= 40) & (longest_token > 0.5 * line_size) & (files == 0) & (commas == 0) & (tags == 0),
        (line_words >= 3) & (menu_line > 0.6 * line_words),
        (line_solid >= 3) & (line_solid - letters - digits > 0.5 * line_solid) & (digits < 0.1 * line_solid) & (files == 0),
        (line_words >= 5) & (broken_words >= 0.25 * line_words) & (files == 0),
        cjk_line,
        (line_words >= 3) & (capitals_at > 0.7 * line_words),
        line_times >= 3,
    ]

    # documents
    total = np.maximum(1, np.bincount(line_doc, line_size, d))
    per_doc = lambda values: np.bincount(line_doc, values, d)
    chars_of = lambda bits: np.bincount(char_doc[has(bits)], minlength=d)
    whole = np.maximum(1, size)
    spaces = chars_of(SPACE) - 1  # the break that was put between texts
    n_lines = np.bincount(line_doc, minlength=d)
    n_words = np.bincount(word_doc, minlength=d)
    w1, l1 = np.maximum(1, n_words), np.maximum(1, n_lines)
    times, new = _times(word_doc, word)
    most = np.zeros(d)
    np.maximum.at(most, word_doc, times)
    longest = np.zeros(d)
    np.maximum.at(longest, word_doc, word_size)
    cjk = chars_of(CJK)
    repeated = _repeated(word_doc, word, d)
    by_character = cjk >= 0.3 * whole
    if by_character.any():
        mine = by_character[char_doc] & solid
        repeated = np.where(by_character, _repeated(char_doc[mine], c[mine].astype(np.uint64), d), repeated)
    known = np.stack([np.bincount(word_doc[flags[:, i]], minlength=d) for i in range(lexicon.languages)], axis=1).max(axis=1)
    packed = []
    for text in texts:
        raw = text.encode("utf-8", "replace")
        packed.append(len(zlib.compress(raw, 1)) / max(1, len(raw)))
    letters_d, digits_d, latin = chars_of(LETTER), chars_of(DIGIT), chars_of(LATIN)
    out = [
        np.log1p(n_words), np.bincount(word_doc, word_size, d) / w1, (size - letters_d - spaces - digits_d) / whole, per_doc(ended) / l1, known / w1,
        np.log1p(size), np.log1p(n_lines), digits_d / whole, chars_of(UPPER) / np.maximum(1, letters_d), spaces / whole, letters_d / whole, chars_of(KANA) / whole, cjk / whole,
        chars_of(VOWEL) / np.maximum(1, latin), np.log1p(longest), np.bincount(word_doc[word_size > 18], minlength=d) / w1, np.bincount(word_doc[new], minlength=d) / w1, most / w1,
        np.array(packed), per_doc(line_times > 1) / l1, repeated, n_words / l1, per_doc(line_words <= 5) / l1, per_doc(bulleted) / l1, per_doc(tabs) / w1, per_doc(pipes) / w1, per_doc(semicolons) / w1,
        per_doc(commas) / w1, per_doc(gaps) / w1, per_doc(cells) / w1, per_doc(pair) / l1, per_doc(files) / w1, per_doc(tags) / w1, per_doc(odd) / whole, per_doc(broken_words) / w1,
        per_doc(in_tokens(of_hex)) / np.maximum(1, per_doc(tokens)), np.bincount(word_doc[flags[:, -1]], minlength=d) / w1, per_doc(capitals_at) / w1,
        *[np.bincount(line_doc, line_size * layout, d) / total for layout in layouts],
    ]
    return np.stack(out, axis=1)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def statistics(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """One row of STATISTICS for each text, zeros for blank ones; every character of every text is read."""
    out = np.zeros((len(texts), len(STATISTICS)))
    there = [i for i, t in enumerate(texts) if t and not t.isspace()]
    at = 0
    for block in _blocks([texts[i] for i in there]):
        out[there[at : at + len(block)]] = _block(block, lexicon)
        at += len(block)
    return out
