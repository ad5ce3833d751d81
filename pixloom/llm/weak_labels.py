"""Weak labels of documents for training: what the structure of each line says, where it leaves no doubt.

These rules label a bounded sample only. They are not inputs of the trees, which see the statistics of whole documents
(quality.STATISTICS), and no document gets its kind from them.
"""

from __future__ import annotations

import re

import numpy as np

KINDS = ("prose", "list", "table", "junk")
LEAST_MARGIN = 0.1

# Words of page furniture.
MENU_WORDS = frozenset([
    "menu", "home", "help", "settings", "privacy", "login", "logout", "signin", "sign", "trash", "albums", "sharing", "share", "save", "print", "next",
    "prev", "previous", "storage", "full", "rights", "cookies", "terms", "contact", "search", "subscribe", "copyright", "imprint", "skip", "reserved", "all", "in",
])

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_KANA = re.compile(r"[぀-ヿ]")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_ODD = re.compile(r"[\u0080-¿ŒœŠšŸŽžƒˆ˜†-•…‰€™─-▟α-ωΑ-Ω≈≠-≥√ⁿ⌐�]")
_ODD_LEAD = re.compile(r"[ÃÂâãäåæçèéï][\u0080-¿ŒœŠšŸŽžƒˆ˜–-‰€™]")
_BULLET = re.compile(r"^\s*(?:[-–—*•·‣◦▪●○☐☑✓✔✗>+]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_PAIR = re.compile(r"^\s*[^\W\d_][\w .()/-]{0,30}?\s*[:=]\s+\S[^!?。]{0,40}$|^\s*[^\W\d_][\w .-]{0,30}\s*=\s*\S{1,40}$")
_FILE = re.compile(r"\w\.(?:jpe?g|png|gif|heic|webp|mp4|mov|avi|raw|dng|tiff?|pdf|docx?|txt|zip|json|csv)\b", re.I)
_TAG = re.compile(r"(?:^|\s)#[^\W_][\w-]*")
_HEX = re.compile(r"(?<!\S)(?:[0-9a-f]{2}|[0-9a-f]{6,})(?!\S)", re.I)
_BROKEN = re.compile(r"[^\W\d_][^\w\s'’.\-/&@,:·#*_=+%()\"“”„«»!?;…<>|][^\W\d_]|[^\W\d_][!|;(){}\[\]~^»«_<>0-9][^\W\d_]|[a-zà-ÿ][A-Z0O1I][a-zà-ÿ]")
_ANY_END = re.compile(r"[.!?…。！？:;,][\"'”»)\]]*\s*$")
_CELL = re.compile(r"</?t[dhr]\b", re.I)
_GAPS = re.compile(r"\s{2,}")
_RULE = re.compile(r"^[\s|:+=-]+$")
_CJK_STOP = re.compile(r"[。、！？]")


def known_share(words: list[str], common: dict[str, frozenset[str]]) -> float:
    """The share of words that are common in the language in which most of them are."""
    return max((sum(w in own for w in words) for own in common.values()), default=0) / len(words) if words else 0.0


def _fields(cut: list[str], known: float) -> bool:
    """Whether the parts of a line are fields: few words each, and not a sentence's share of common words."""
    return len(cut) >= 3 and sum(len(x.split()) for x in cut) <= 3.5 * len(cut) and known < 0.3


def line_kind(line: str, words: list[str], known: float) -> str:
    """What the structure of one line says beyond doubt; `open` where it says nothing. words: in lower case."""
    size, n = len(line), len(words)
    tokens = line.split()
    solid = max(1, sum(map(len, tokens)))
    files, tags = len(_FILE.findall(line)), len(_TAG.findall(line))
    if len(_CELL.findall(line)) >= 3 or _RULE.match(line) and "|" in line:
        return "table"
    if len(_KANA.findall(line)) + len(_CJK.findall(line)) > 0.3 * solid:
        return "prose" if _CJK_STOP.search(line) or size > 25 else "open"
    letters, digits = sum(map(str.isalpha, line)), sum(map(str.isdigit, line))
    odd = len(_ODD.findall(line)) + len(_ODD_LEAD.findall(line))
    if odd >= 3 and odd > 0.12 * size:
        return "junk"
    if len(tokens) >= 6 and (len(_HEX.findall(line)) >= 0.7 * len(tokens) or sum(map(str.isdigit, tokens)) >= 0.9 * len(tokens)):
        return "junk"
    longest = max(map(len, tokens), default=0)
    if longest >= 40 and longest > 0.5 * size and not files and "," not in line and not tags:
        return "junk"
    if n >= 3 and sum(w in MENU_WORDS for w in words) > 0.6 * n:
        return "junk"
    symbols = solid - letters - digits
    if solid >= 3 and symbols > 0.5 * solid and digits < 0.1 * solid and not files:
        return "junk"
    if n >= 5 and len(_BROKEN.findall(line)) >= 0.25 * n and not files:
        return "junk"
    for mark in ("\t", "|", " ; ", None):
        cut = [x for x in (_GAPS.split(line.strip()) if mark is None else line.split(mark)) if mark in ("\t", " ; ") or x.strip()]
        if _fields(cut, known):
            return "table"
    for mark in (";", ","):
        cut = line.split(mark)
        if len(cut) >= 3 and mark + " " not in line and max(len(x.split()) for x in cut) <= 5 and _fields(cut, known):
            return "table"
        if len(cut) >= 3 and files and sum(any(map(str.isdigit, x)) for x in cut) >= 2 and _fields(cut, known):
            return "table"
    if _PAIR.match(line) and n <= 8 and known < 0.3:
        return "table"
    if files and (n <= 12 and known < 0.2 or files * 6 > n):
        return "list"
    if tags >= 3 and tags > 0.4 * n:
        return "list"
    for mark in (",", " / ", "/", "·", ";", "•", " - ", "|"):
        cut = [x for x in line.split(mark) if x.strip()]
        if len(cut) >= 5 and sum(len(x.split()) for x in cut) <= 2.2 * len(cut) and known < 0.25:
            return "list"
    if _BULLET.match(line) and n <= 9:
        return "list"
    if n >= 8 and known < 0.13 and not digits and letters > 0.75 * solid and sum(w[:1].isupper() for w in tokens) < 0.3 * len(tokens):
        return "junk"
    if n >= 6 and known >= 0.2:
        return "prose"
    return "open"


def repeated_share(items: list[str], span: int = 6) -> float:
    """The share of items within phrases of `span` that occur three times or more."""
    if len(items) < 9:
        return 0.0
    span = min(span, len(items) // 3)
    ids: dict[str, int] = {}
    numbers = np.fromiter((ids.setdefault(x, len(ids)) for x in items), dtype=np.uint64, count=len(items))
    last = len(items) - span + 1
    phrases = np.zeros(last, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            phrases = phrases * np.uint64(0x9E3779B97F4A7C15) + numbers[k : last + k] + np.uint64(1)
    _, which, times = np.unique(phrases, return_inverse=True, return_counts=True)
    begin = np.flatnonzero(times[which] >= 3)
    inside = np.zeros(len(items) + 1, dtype=np.int64)
    inside[begin] += 1
    inside[begin + span] -= 1
    return float((inside.cumsum() > 0).sum()) / len(items)


def shares(text: str, common: dict[str, frozenset[str]]) -> dict[str, float]:
    """The share of the characters of a text that lies in lines of each kind; the rest is open."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    found = dict.fromkeys((*KINDS, "open"), 0)
    listy, lower = [], []
    for line in lines:
        own = [w.lower() for w in WORD.findall(line)]
        lower += own
        kind = line_kind(line, own, known_share(own, common))
        if kind == "open" and len(own) <= 6:
            listy.append(len(line))
        found[kind] += len(line)
    # short lines that say nothing alone are a list when there are many of them and they are not pieces of sentences
    wrapped = len(lines) > 1 and sum(1 for a, b in zip(lines, lines[1:]) if b[:1].islower() and not _ANY_END.search(a) and len(a) > 24) / (len(lines) - 1)
    if len(listy) >= 3 and not wrapped > 0.4:
        found["list"] += sum(listy)
        found["open"] -= sum(listy)
    furniture = sum(w in MENU_WORDS for w in lower) / max(1, len(lower))
    ideographs = len(_CJK.findall(text)) >= 0.3 * len(text)
    if repeated_share([c for c in text if not c.isspace()] if ideographs else lower) > 0.6 or furniture > 0.5 and len(lower) >= 6:
        for kind in ("prose", "open", "list", *(("table",) if furniture > 0.5 else ())):
            found["junk"] += found[kind]
            found[kind] = 0
    total = max(1, sum(found.values()))
    return {k: v / total for k, v in found.items()}


def weak_label(text: str | None, common: dict[str, frozenset[str]]) -> str | None:
    """The kind that most characters of a text have, LEAST_MARGIN of all ahead of the next; null if the lines leave doubt."""
    if not text or not text.strip():
        return None
    by = sorted(((v, k) for k, v in shares(text, common).items()), reverse=True)
    return by[0][1] if by[0][1] != "open" and by[0][0] - by[1][0] >= LEAST_MARGIN else None
