"""Sequence alignment as pandas UDFs: matching blocks of token lists, fuzzy ratios, merged readings.

Rows are candidates already narrowed by a join (a band, a window, a shared n-gram); the UDFs decide
on one row at a time with the standard library's matcher, or in `ratio` by its rules.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import Match, SequenceMatcher
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts of more characters, or what has longer runs in common, are left to the standard library's matcher.
LONG_TEXT, LONG_RUN = 4096, 32


def find(line: list[str], words: list[str], times: list[float]) -> tuple[float | None, float]:
    """The time of the first word that matches, and the share of the line that is found."""
    blocks = [b for b in SequenceMatcher(None, line, words, autojunk=False).get_matching_blocks() if b.size]
    if not line or not blocks:
        return None, 0.0
    return float(times[blocks[0].b]), sum(b.size for b in blocks) / len(line)


def _longest(levels: list[tuple[list[int], list[int]]], most: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common run of a stretch of both sides, the first of equals: its places and length. levels: for
    each length the places in `a` where runs end, and for each of these the places in b, as bits."""
    for k in range(min(most, ahi - alo, bhi - blo), 0, -1):
        ends, places = levels[k - 1]
        window = (1 << bhi) - (1 << blo + k - 1)
        first = bisect_left(ends, alo + k - 1)
        hit = next((x for x in range(first, bisect_left(ends, ahi, first)) if places[x] & window), None)
        if hit is not None:
            bits = places[hit] & window
            return ends[hit] - k + 1, (bits & -bits).bit_length() - k, k
    return alo, blo, 0


def _bits(words: list[str]) -> dict[str, int]:
    """For each word its places, as bits of a whole number."""
    out: dict[str, int] = {}
    for j, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << j
    return out


def _blocks(line: list[str], words: list[str]) -> list[Match]:
    """Matching blocks as the standard matcher finds them. The ends of all common runs of each length are found
    once, a word of the line and all of `words` at a time; each stretch then takes its longest run from these."""
    at = _bits(words)
    level = single = {i: bits for i, w in enumerate(line) if (bits := at.get(w))}
    levels: list[tuple[list[int], list[int]]] = []
    while level:
        if len(levels) == LONG_RUN:
            return [b for b in SequenceMatcher(None, line, words, autojunk=False).get_matching_blocks() if b.size]
        levels.append((list(level), list(level.values())))
        level = {i + 1: both for i, bits in level.items() if (both := single.get(i + 1, 0) & bits << 1)}
    out, todo = [], [(0, len(line), 0, len(words), len(levels))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        i, j, size = _longest(levels, most, alo, ahi, blo, bhi)
        if size:
            out.append(Match(i, j, size))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, size))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi, size))
    return sorted(out)


def _first_run(blocks):
    """The first block of two words or more, else the first one."""
    return min(blocks, key=lambda b: (b.size < 2, b.a))


def find_start(line: list[str], words: list[str], times: list[float], per_word: float = 0.3) -> tuple[float | None, float]:
    """When the line began, and the share of it that is found: at its first two words or more in a row
    (else its first word found), less a bit for each word before."""
    blocks = _blocks(line, words) if line else []
    if not blocks:
        return None, 0.0
    run = _first_run(blocks)
    return float(times[run.b]) - per_word * run.a, sum(b.size for b in blocks) / len(line)


def _shared(line: list[str], words: list[str], starts: range, size: int) -> list[int]:
    """How many words each stretch of `size` words from one of `starts` on has with the line in common, in
    any order: no match of the two is longer."""
    want, have, n, out, end, begin = Counter(line), Counter(), 0, [], 0, 0
    for s in starts:
        for w in words[end : s + size]:
            n += have[w] < want[w]
            have[w] += 1
        for w in words[begin:s]:
            have[w] -= 1
            n -= have[w] < want[w]
        begin, end = s, min(s + size, len(words))
        out.append(n)
    return out


def _in_order(own: dict[str, int], n: int, words: list[str]) -> int:
    """The length of the longest sequence that a line of n words (`own`: its `_bits`) and `words` have in common,
    with gaps: no match of the two has more. A bit of the line stays set until the sequence reaches it."""
    left = every = (1 << n) - 1
    for w in words:
        if (bits := own.get(w)) is not None and (hit := left & bits):
            left = (left + hit | left - hit) & every
    return n - left.bit_count()


def find_unique(line: list[str], words: list[str], times: list[float], apart: float = 20, by: int = 2, least: float = 0.0) -> tuple[float | None, float]:
    """The same, but only if the best place has `least` of the line and beats by over `by` words any other
    whose words are all more than `apart` away from its own. Places are tried at every second word, those
    that may have most of the line first, until no other can come near the best; of equals the last wins. What
    a place may have is first the words it shares with the line, then those it has in the line's order."""
    n, tried, most = len(line), [], 0
    starts = range(0, max(1, len(words) - n // 2), 2)
    own, places = _bits(line), [(-bound, -s, False) for bound, s in zip(_shared(line, words, starts, n + 6), starts)]
    heapify(places)
    while places:
        bound, s, ordered = heappop(places)
        bound, s = -bound, -s
        if not bound or bound < most - by or not most and bound / n < least:
            break
        if not ordered:
            heappush(places, (-_in_order(own, n, words[s : s + n + 6]), -s, True))
            continue
        blocks = _blocks(line, words[s : s + n + 6])
        run = _first_run(blocks)
        score = sum(b.size for b in blocks)
        most = max(most, score if score / n >= least else 0)
        tried.append({"score": score, "at": s + run.b, "skipped": run.a, "first": s + blocks[0].b, "last": s + blocks[-1].b + blocks[-1].size - 1})
    if not line or not most:
        return None, 0.0
    best = max(tried, key=lambda x: tuple(x.values()))
    clear = lambda x: times[x["last"]] < times[best["first"]] - apart or times[x["first"]] > times[best["last"]] + apart
    if any(x["score"] >= best["score"] - by for x in tried if clear(x)):
        return None, 0.0
    return float(times[best["at"]]) - 0.3 * best["skipped"], best["score"] / n


def merged(old: list[str], new: list[str], known: set[str]) -> list[str]:
    """Two readings of one line, word by word: where they differ, the one with more known words."""
    out: list[str] = []
    for op, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        x, y = old[a:b], new[c:d]
        score = lambda ws: sum(w in known for w in ws)
        out += x if op == "equal" or score(x) > score(y) or (score(x) == score(y) and len(x) >= len(y)) else y
    return out


def find_run(line: list[str], words: list[str], times: list[float], per_word: float = 0.3) -> tuple[float | None, float]:
    """When the line began, by the longest stretch of it that is heard without a break, and the share
    found; only if that stretch has two words and half the line is found, or five words. A callsign that
    opens a line is often in the one before too, so the first stretch says little. From the longest one
    back, earlier stretches count while what lies between is no longer heard than its words take (and
    four seconds); of single words only those of the line's opening do."""
    blocks = _blocks(line, words) if line else []
    if not blocks:
        return None, 0.0
    share = sum(b.size for b in blocks) / len(line)
    k = max(range(len(blocks)), key=lambda j: (blocks[j].size, -j))
    start = longest = blocks[k]
    for b in blocks[:k][::-1]:
        opening = b.size > 1 or b.a < 3
        if opening and times[start.b] - times[b.b + b.size - 1] > start.a - b.a - b.size + 4:
            break
        start = b if opening else start
    if longest.size < 2 or (share < 0.5 and longest.size < 5):
        return None, share
    return float(times[start.b]) - per_word * start.a, share


@lru_cache(maxsize=64)
def _places(b: str) -> dict[str, int]:
    """For each character of b its places, as bits of a whole number. As in the standard matcher, those that
    make up over a hundredth of 200 characters or more are left out."""
    most, out = len(b) // 100 + 1 if len(b) >= 200 else len(b), {}
    for c in set(b):
        if b.count(c) <= most:
            bits, j = 0, b.find(c)
            while j >= 0:
                bits |= 1 << j
                j = b.find(c, j + 1)
            out[c] = bits
    return out


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(). The ends of all common runs of each length are found once, a place
    of `a` and all of b at a time; each stretch then takes its longest run, the first of equals, from these."""
    if a == b:
        return 1.0
    if max(len(a), len(b)) > LONG_TEXT:
        return SequenceMatcher(None, a, b).ratio()
    at = _places(b)
    level = single = {i: bits for i, c in enumerate(a) if (bits := at.get(c))}
    levels: list[tuple[list[int], list[int]]] = []
    while level:
        if len(levels) == LONG_RUN:
            return SequenceMatcher(None, a, b).ratio()
        levels.append((list(level), list(level.values())))
        level = {i + 1: both for i, bits in level.items() if (both := single.get(i + 1, 0) & bits << 1)}
    found, todo = 0, [(0, len(a), 0, len(b), len(levels))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        i, j, size = _longest(levels, most, alo, ahi, blo, bhi)
        most = size
        # Frequent characters start no run, but lengthen one.
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            found += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, most))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi, most))
    return 2.0 * found / (len(a) + len(b))


FOUND = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("share", T.DoubleType())])


def _found_udf(find_one):
    """find_one over rows; a null line, null words or null times are not found."""

    @F.pandas_udf(FOUND)
    def found(line: pd.Series, words: pd.Series, times: pd.Series) -> pd.DataFrame:
        rows = [(None, 0.0) if a is None or b is None or c is None else find_one(list(a), list(b), list(c)) for a, b, c in zip(line, words, times)]
        return pd.DataFrame(rows, columns=["t", "share"])

    return found


find_udf, find_start_udf, find_unique_udf, find_run_udf = map(_found_udf, (find, find_start, find_unique, find_run))


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts are; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def merge_udf(known: list[str]):
    """known: a vocabulary of bounded size, sent with the function."""
    if sum(map(len, known)) > 16 << 20:
        raise ValueError("a vocabulary of over 16 MB is joined, not sent with a function")
    words = set(known)

    @F.pandas_udf("array<string>")
    def merge(old: pd.Series, new: pd.Series) -> pd.Series:
        # Where one reading is null, the other is all there is.
        return pd.Series([b if a is None else a if b is None else merged(list(a), list(b), words) for a, b in zip(old, new)])

    return merge
