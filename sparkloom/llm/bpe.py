"""Byte-level BPE: exact encoding by per-prefix dynamic programming, and decoding.

For a pre-token, every prefix has exactly one encoding, hence one last token. An automaton of the
vocabulary matches suffixes (its states are the prefixes of tokens; a step goes to the longest suffix
of what was read that is one, as in Aho-Corasick automata, and states are built when first reached). It
reports, at each end position, all tokens that are suffixes of the prefix read so far; the one whose
predecessor (the last token of what remains before it) stays a separate token beside it is the last
token of that prefix. Following the stored back-pointers from the end gives the ids. No merge queue
is run.

Texts are cut at blanks first, where the pre-tokenizer always cuts too, so that the cache of a worker
serves whole blank-separated pieces. Texts in which a blank has white space on both sides, where
this does not hold, take the full pattern.

Null text counts as empty: no ids, and the decoded text is empty.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = 1 << 60
GENERATION = 50_000  #: pieces in each of the two generations of a worker's cache
MOST_PAIRS = 200_000  #: pairs of tokens that a worker remembers
LONGEST_CACHED = 48

# The white space of Unicode, as the published pre-tokenizer's \s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# The contractions of the published byte-level pre-tokenizer.
CONTRACTIONS = "s|t|re|ve|m|ll|d"


def byte_chars() -> dict[str, int]:
    """The published printable alphabet of byte-level vocabularies: char -> byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def class_of(kind: str) -> str:
    """A regex class body with all code points whose category starts with kind, as ranges."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


def pre_token_pattern() -> re.Pattern:
    letter, number = class_of("L"), class_of("N")
    return re.compile(f"'(?:{CONTRACTIONS})| ?[{letter}]+| ?[{number}]+| ?[^{SPACES}{letter}{number}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def plain_bpe(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Textbook merging, for checking single tokens when a vocabulary is read."""
    while len(symbols) > 1:
        best = min((merges.get(p, (INF, -1)) + (k,) for k, p in enumerate(zip(symbols, symbols[1:]))))
        if best[0] == INF:
            break
        k = best[2]
        symbols = symbols[:k] + [best[1]] + symbols[k + 2 :]
    return symbols


class Bpe:
    """A vocabulary file made ready. Bounded by the vocabulary, not by any data."""

    def __init__(self, spec: str, unreachable: frozenset[int] = frozenset()):
        """unreachable: ids that merging never makes, from unreachable_ids()."""
        j = json.loads(spec)
        chars = byte_chars()
        # Words are held as Latin-1 strings, one char for each byte.
        latin = lambda token: "".join([chr(chars[c]) for c in token])
        self.ids = {latin(t): i for t, i in j["model"]["vocab"].items() if all(c in chars for c in t)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(j["model"]["merges"]):
            a, b = (latin(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge_rank[left, right] = rank
            self.merges[left, right] = (rank, made)
            if made not in self.made_at:
                self.made_at[made], self.halves[made] = rank, (left, right)
        if unreachable:  # what merging makes was found before; ranks are all that is still asked for
            self.merges.clear()
        self.whole = {t: i for t, i in self.ids.items() if i not in unreachable}
        # The automaton: a state is its steps (char -> state), its outputs (id, size) and its prefix.
        # Steps and outputs are filled in when first taken.
        self.prefixes = {t[:k] for t in self.whole for k in range(len(t) + 1)}
        self.states: dict[str, tuple] = {}
        self.start = self.state("")
        self.pattern = pre_token_pattern()
        self.blank_in_space = re.compile(f"[{SPACES}] (?![^{SPACES}])")
        added = [(x["content"], x["id"]) for x in j.get("added_tokens") or []]
        self.added = dict(added)
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t, _ in sorted(added, key=lambda x: -len(x[0]))) + ")") if added else None
        self.bytes_of = {i: t.encode("latin-1") for t, i in self.ids.items()} | {i: t.encode() for t, i in added}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.table))]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.table]
        self.n_pairs = 0
        self.marks = {c for c in ",.;:!?" if c in self.whole}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unreachable_ids(self) -> frozenset[int]:
        single = [self.ids[chr(b)] for b in range(256)]
        return frozenset(i for t, i in self.ids.items() if plain_bpe([single[ord(c)] for c in t], self.merges) != [i])

    def state(self, prefix: str) -> tuple:
        got = self.states.get(prefix)
        if got is None:
            ends = [prefix[k:] for k in range(len(prefix))]
            got = self.states[prefix] = ({}, tuple((self.whole[t], len(t)) for t in ends if t in self.whole), prefix)
        return got

    def step(self, state: tuple, c: str) -> tuple:
        """To the longest suffix of what was read that is a prefix of a token."""
        p = state[2] + c
        while p not in self.prefixes:
            p = p[1:]
        to = state[0][c] = self.state(p)
        return to

    def apart(self, a: int, b: int) -> bool:
        """Whether token a followed by token b stays two tokens.

        Undoes the merges of a's right edge and b's left edge from the latest to the earliest. The
        two must not be joined by a merge that comes before what their parents are made by; at the
        same rank the leftmost place is merged first."""
        made, merge, halves = self.made_at, self.merge_rank, self.halves
        x, y, above_x, above_y = a, b, INF, INF
        while True:
            rank = merge.get((x, y))
            if rank is not None and rank < above_x and rank <= above_y:
                return False
            at_x, at_y = made.get(x, -1), made.get(y, -1)
            if at_x < 0 and at_y < 0:
                return True
            if at_x > at_y:
                above_x, x = at_x, halves[x][1]
            else:
                above_y, y = at_y, halves[y][0]

    def word(self, s: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        t = s if s.isascii() else s.encode().decode("latin-1")
        packed = self.packed
        one = self.whole.get(t)
        if one is not None:
            return packed[one]
        pairs, state = self.pairs, self.start
        last, back, i = [0], [0], 0
        for c in t:
            i += 1
            to = state[0].get(c)
            state = self.step(state, c) if to is None else to
            for tid, size in state[1]:
                j = i - size
                if not j:
                    break
                before = last[j]
                ok = pairs[before].get(tid)
                if ok is None:
                    ok = self.remember(before, tid)
                if ok:
                    break
            last.append(tid)
            back.append(j)
        out = []
        while i:
            out.append(packed[last[i]])
            i = back[i]
        out.reverse()
        return b"".join(out)

    def remember(self, a: int, b: int) -> bool:
        self.n_pairs += 1
        if self.n_pairs > MOST_PAIRS:  # the memo is bounded; it fills again
            self.pairs[:] = [{} for _ in self.table]
            self.n_pairs = 0
        ok = self.pairs[a][b] = self.apart(a, b)
        return ok

    def piece(self, s: str) -> bytes:
        """Ids of a blank and then s."""
        got = self.old.get(s)
        if got is None:
            if s.isalpha():  # exactly the letters of the pattern: one pre-token
                got = self.word(" " + s)
            elif s[-1:] in self.marks and s[:-1].isalpha():  # a word and a mark: two
                head = s[:-1]
                got = (self.young.get(head) or self.piece(head)) + self.packed[self.whole[s[-1]]]
            else:
                got = b"".join([self.word(x) for x in self.pattern.findall(" " + s)])
        if len(s) <= LONGEST_CACHED:
            if len(self.young) >= GENERATION:
                self.old, self.young = self.young, {}
            self.young[s] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = []
        parts = self.split_added.split(text) if self.split_added and any(t in text for t in self.added) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif self.blank_in_space.search(part):
                out += [self.word(x) for x in self.pattern.findall(part)]
            else:
                first, *pieces = part.split(" ")
                out += [self.word(x) for x in self.pattern.findall(first)]
                for s in pieces:
                    got = self.young.get(s)
                    out.append(self.piece(s) if got is None else got)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


_READY: dict[str, Bpe] = {}


class Spec:
    """A broadcast tokenizer file; its size is that of the vocabulary (1.6 MB for 50 k tokens)."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if len(text) > 64 << 20:
            raise ValueError("a tokenizer file of over 64 MB is not broadcast")
        self.key = hashlib.sha256(text.encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast((text, Bpe(text).unreachable_ids()))

    def ready(self) -> Bpe:
        """The vocabulary, built once in each Python worker."""
        if self.key not in _READY:
            _READY.clear()
            _READY[self.key] = Bpe(*self.sent.value)
        return _READY[self.key]


def encode(df: DataFrame, spec: Spec, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds `to`: the token ids of the whole text as packed little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def ids(col: pa.Array) -> pa.Array:
        bpe = spec.ready()
        return pa.array([bpe.encode(x) for x in col.to_pylist()], pa.binary())

    return df.withColumn(to, ids(F.col(text)))


def decode(df: DataFrame, spec: Spec, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds `to`: the text of packed ids; broken UTF-8 becomes U+FFFD as in the library."""

    @F.arrow_udf("string")
    def back(col: pa.Array) -> pa.Array:
        bpe = spec.ready()
        return pa.array([bpe.decode(x) for x in col.to_pylist()], pa.string())

    # Python functions applied directly to one another are run as one, and the inner one again for
    # its own column; with an expression between them the ids are made once.
    return df.withColumn(to, back(F.coalesce(F.col(ids), F.lit(b""))))


def round_trip(df: DataFrame, spec: Spec, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() of its ids in one Python worker: two functions on one another would
    hold two workers, each with the vocabulary, for every task. What is made of some texts is handed on
    before the next ones are read, so that no worker holds the ids and texts of a whole batch."""
    from .common import tidy

    own = [c for c in df.columns if c not in (ids, decoded)]
    kinds = T.StructType([*df.select(*own).schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def both(batches):
        bpe, step = spec.ready(), 256
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                made = [bpe.encode(x) for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, own), pa.array(made, pa.binary()), pa.array(list(map(bpe.decode, made)), pa.string())], names=[*own, ids, decoded])
        tidy()

    return df.mapInArrow(both, kinds)
