"""Benchmark decontamination: one Aho-Corasick automaton over the words of all benchmark items.

Texts are normalised to lower-case ASCII words; items give windows of ten consecutive words (fewer:
the whole item). Any window holds one of its item's runs of five words that start at a multiple of
five, so the automaton's keys are these runs, as numbers of words; it reads each normalised text once.
Where a run is found, the words around it are held against the item's, and ten or more in a row are a
hit. Word positions are mapped back to character offsets of the original text.

An automaton takes items of at most `block_bytes`, about a node for each word. A larger benchmark is
not broadcast: windows of texts and items are joined by hashes, and each text is scanned with the
items that it shares a window with.

Null and word-less texts have no words, no hits and no items; items without words give no window. An
empty benchmark gives no hits, no documents no rows. Repeated item ids count once. An item without an
id counts as one item, which is not listed by name in `array_join`. Repeated rows are each reported.
`to` replaces a column of its name; all other columns stay.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

WINDOW = 10
#: Item text that one automaton takes.
BLOCK_BYTES = 2 << 20

WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

RESULT = "struct<n_words:bigint,ranges:array<struct<word_from:int,word_to:int,char_from:int,char_to:int>>,items:array<string>>"
ARROW = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([(n, pa.int32()) for n in ("word_from", "word_to", "char_from", "char_to")]))), ("items", pa.list_(pa.string()))])


def words(raw: bytes | None) -> list[bytes]:
    return raw.translate(TABLE).split() if raw else []


class Items:
    """The words of the items as numbers, and the automaton over their runs."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, run = window, window // 2
        self.number: dict[bytes, int] = {}
        self.lists: list[list[int]] = []
        self.names: list[set[str | None]] = []
        known: dict[tuple[int, ...], int] = {}
        keys: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, raw in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in words(raw))
            if w in known:  # equal items are one, with several names
                self.names[known[w]].add(name)
                continue
            if w:
                known[w] = len(self.lists)
                starts = range(0, len(w) - run + 1, run) if len(w) >= window else (0,)
                for k in starts:
                    keys.setdefault(w[k : k + run] if len(w) >= window else w, []).append((len(self.lists), k))
                self.lists.append(list(w))
                self.names.append({name})
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in keys.items():
            self.automaton.add_word(key, (len(key), places))
        if keys:
            self.automaton.make_automaton()

    def hits(self, w: list[bytes]) -> list[tuple[int, int, int]]:
        """Runs of words, as first, last (exclusive) and item, that are windows or longer."""
        if not self.lists or not w:
            return []
        get = self.number.get
        own = tuple([get(x, 0) for x in w])
        out, reached = [], {}
        for end, (n, places) in self.automaton.iter(own):
            begin = end - n + 1
            for item, at in places:
                theirs = self.lists[item]
                if len(theirs) < self.window:
                    out.append((begin, end + 1, item))
                    continue
                if reached.get((item, begin - at), -1) > end:  # inside a run that is known
                    continue
                a, z = begin, end + 1
                while a > 0 and a - begin + at > 0 and own[a - 1] == theirs[a - 1 - begin + at]:
                    a -= 1
                while z < len(own) and z - begin + at < len(theirs) and own[z] == theirs[z - begin + at]:
                    z += 1
                reached[item, begin - at] = z
                if z - a >= self.window:
                    out.append((a, z, item))
        return out


def scan(items: Items, raw: bytes | None) -> dict:
    w = words(raw)
    out = {"n_words": len(w), "ranges": [], "items": []}
    found = items.hits(w)
    if not found:
        return out
    runs: list[list[int]] = []
    for a, z, _ in sorted(found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    at = [m.span() for m in WORD_BYTES.finditer(raw)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # before each byte
    out["ranges"] = [{"word_from": a, "word_to": z, "char_from": int(chars[at[a][0]]), "char_to": int(chars[at[z - 1][1]])} for a, z in runs]
    out["items"] = sorted(set().union(*(items.names[k] for _, _, k in found)), key=lambda x: (x is not None, x))
    return out


def windows(lengths: list[int], columns: list[str]):
    """Hashes of all runs of the given numbers of words, and for items of the whole of shorter ones."""

    def run(batches):
        for b in batches:
            keys, out, own = b.column(columns[0]), [], []
            for k, raw in enumerate(b.column(columns[1]).cast(pa.binary()).to_pylist()):
                w = words(raw)
                sizes = lengths or ([min(WINDOW, len(w))] if w else [])
                got = {hash_of(b" ".join(w[j : j + n])) for n in sizes for j in range(len(w) - n + 1)}
                out += got
                own += [k] * len(got)
            yield pa.record_batch([keys.take(pa.array(own, pa.int64())), pa.array(out, pa.binary())], [columns[0], "h"])

    return run


def hash_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


_BUILT: dict[str, Items] = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame, to: str = "leaks", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds `to`, a struct of n_words, the merged hit ranges (words and characters) and the items.

    Items are broadcast if their texts have `block_bytes` at most; then documents are not shuffled."""
    bench = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("raw"))
    if (bench.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) > block_bytes:
        return joined_leaks(docs, bench, to, text)
    sent = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["raw"])) for r in bench.collect()])
    key = uuid.uuid4().hex  # of the automaton that a worker keeps

    @F.arrow_udf(RESULT)
    def leaks(col: pa.Array) -> pa.Array:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Items(sent.value)
        return pa.array([scan(_BUILT[key], raw) for raw in col.cast(pa.binary()).to_pylist()], ARROW)

    return docs.withColumn(to, leaks(F.col(text)))


def joined_leaks(docs: DataFrame, bench: DataFrame, to: str, text: str) -> DataFrame:
    """The same by a join on hashed windows. What a text collects is the items that occur in it."""
    row, mine = fresh(docs, "_row"), fresh(docs, "_items")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    items = stored(bench.withColumn("at", F.monotonically_increasing_id()), "items")
    theirs = items.select("at", "raw").mapInArrow(windows([], ["at", "raw"]), "at long, h binary")
    lengths = sorted(r[0] for r in items.mapInArrow(lengths_of, "n int").distinct().collect())  # at most ten
    ours = rows.select(row, text).mapInArrow(windows(lengths or [WINDOW], [row, text]), f"`{row}` long, h binary")
    pairs = ours.join(theirs, "h").select(row, "at").distinct().join(items, "at")
    found = pairs.groupBy(row).agg(F.collect_list(F.struct("item", "raw")).alias(mine))

    @F.arrow_udf(RESULT)
    def leaks(col: pa.Array, own: pa.Array) -> pa.Array:
        lists = [[(x["item"], x["raw"]) for x in xs or ()] for xs in own.to_pylist()]
        return pa.array([scan(Items(x), raw) for x, raw in zip(lists, col.cast(pa.binary()).to_pylist())], ARROW)

    return rows.join(found, row, "left").withColumn(to, leaks(F.col(text), F.col(mine))).drop(row, mine)


def lengths_of(batches):
    for b in batches:
        yield pa.record_batch([pa.array(sorted({min(WINDOW, len(words(raw))) for raw in b.column("raw").to_pylist()} - {0}), pa.int32())], ["n"])


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Documents that hold no benchmark window, with their columns as they were."""
    to = fresh(docs, "leaks")
    return find_leaks(docs, benchmark, to, **kw).where(F.size(f"{to}.ranges") == 0).drop(to)
