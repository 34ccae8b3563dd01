"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if a 100-byte string that covers it also starts earlier: in an earlier batch, in a
document of smaller id, or earlier in the same one; strings are judged on the input. Matches never
cross documents.

Suffix arrays need not hold every suffix. Every 100-byte string has an anchor, the 24-byte string in
it with the least hash, and equal strings have it at the same place; so the suffixes that start at
anchors suffice, each with the bytes before it that strings with this anchor reach. Neighbouring
strings mostly share an anchor: a stretch is a run of starts with one anchor.

1. Each task lists the stretches of its documents. Stretches of a block that are equal byte for byte
   are settled at once: all but the first are repeats. An anchor that a block has several times is
   known to be shared and sends one row only; the other anchors are dealt out to find shared ones.
   Of equal texts (SHA-256) the first stands for all; the others are repeats as a whole.
2. The bytes of stretches with a shared anchor are fetched and dealt out by anchor. Each task takes
   them in order, in batches. A batch gets a suffix array, is merge-scanned with the suffixes of the
   same anchors in all earlier levels, and becomes a level itself, less what is repeated as a whole;
   levels of equal size merge, two sorted arrays into one. The common prefixes of neighbours, to the
   right and to the left of the anchor, tell for each place of the anchor which strings are equal, so
   no pairs are compared and no string is judged by a hash.
3. An anchor with over `hot` stretches is not left to one task: its strings are dealt out by the place
   of the anchor in them, eleven places at a time, and by the bytes that all strings of such a group
   share. Each part is treated as in 2.

`Index` keeps anchors and texts of earlier batches as tables, in levels that merge geometrically too.

Null text counts as empty; texts of under 100 bytes are kept whole. Rows that agree in id and text
are one document; of rows with one id and different texts, the one with the smaller text hash is the
earlier. Ids are whole numbers; a null id comes before all. No rows give no rows. Other columns stay,
whatever their names; only `to` is replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, drop_stored, fresh, stored
from .jaccard_join import BYTE_VALUE, mixed, pieces, powers

LONG, ANCHOR = 100, 24
SPREAD = LONG - ANCHOR + 1  #: places of an anchor in a string
HOT, GROUP = 20_000, 11
BATCH = 8192
ROWS_A_TASK, POSTS_A_TASK = 60_000, 2_000_000
MOST_BYTES = 1 << 26  #: of a text that are hashed at a time

# A place packs the first start (31 bits) and the starts less one (7 bits).
COUNT_BITS = 7
POST = "key long, seq long, doc long, tie long, place long, kind int"  #: kind 0: to deal out; 1: repeats; 2: anchor is shared


def pack(start, count):
    return start << COUNT_BITS | (count - 1)


def unpack(place):
    return place >> COUNT_BITS, (place & ((1 << COUNT_BITS) - 1)) + 1


class Block:
    """Hashes of all ranges of some texts laid end to end."""

    def __init__(self, raws: list[bytes]):
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.bytes = b"".join(raws)
        self.flat = np.frombuffer(self.bytes, np.uint8)
        power, self.inverse = powers(len(self.flat) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[self.flat] * power[: len(self.flat)])])
        self.base = np.cumsum(self.sizes) - self.sizes

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.inverse[start], salt)

    def stretches(self):
        """Document row, first start, starts and anchor of each stretch; positions in the block."""
        none = np.zeros(0, np.int64)
        n = len(self.flat)
        if n < LONG:
            return none, none, none, none
        rolled = mixed((self.total[ANCHOR:] - self.total[:-ANCHOR]) * self.inverse[: n - ANCHOR + 1], 3)
        low = (rolled >> np.uint64(28) << np.uint64(28)) | np.arange(len(rolled), dtype=np.uint64)
        k = 1
        while 2 * k <= SPREAD:  # minima over 2, 4, ... places, then the rest
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[: len(low) - (SPREAD - k)], low[SPREAD - k :]) if SPREAD > k else low
        anchor = (low & np.uint64((1 << 28) - 1)).astype(np.int64)  # of the string that starts here
        starts = np.maximum(self.sizes - LONG + 1, 0)
        row = np.repeat(np.arange(len(self.sizes)), starts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + self.base[row]
        anchor = anchor[at]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(row)))
        return row[first], at[first], count, anchor[first]


def blocks(batches, columns: list[str]):
    """The columns, one block of texts, and where each of its texts begins in its document. A text of
    over MOST_BYTES is cut into several, which overlap so that each string starts in one."""
    for cols, raws in pieces(batches, [*columns, "text"]):
        which, texts, offset = [], [], []
        for k, raw in enumerate(raws):
            for s in range(0, max(1, len(raw or b"") - LONG + 1), MOST_BYTES):
                which.append(k)
                offset.append(s)
                texts.append((raw or b"")[s : s + MOST_BYTES + LONG - 1])
        held = 0
        while held < len(texts):  # several blocks only where a text was cut
            stop, size = held + 1, len(texts[held])
            while stop < len(texts) and size + len(texts[stop]) <= MOST_BYTES:
                size += len(texts[stop])
                stop += 1
            yield [c.take(pa.array(which[held:stop])) for c in cols], Block(texts[held:stop]), np.array(offset[held:stop])
            held = stop


def posts(batches):
    for cols, b, offset in blocks(batches, ["seq", "doc", "tie"]):
        seq, doc, tie = (c.to_numpy() for c in cols)
        row, at, count, anchor = b.stretches()
        key = b.hashes(anchor, anchor + ANCHOR, 4).view(np.int64)
        name = b.hashes(at, at + count - 1 + LONG, 5)
        start = at - b.base[row] + offset[row]
        order = np.lexsort((start, tie[row], doc[row], seq[row], name, key))
        key, name, at, count, row, start = (x[order] for x in (key, name, at, count, row, start))
        kind = np.zeros(len(key), np.int32)
        like = (key[1:] == key[:-1]) & (name[1:] == name[:-1]) & (count[1:] == count[:-1])
        first = np.arange(len(key))
        for k in (np.flatnonzero(like) + 1).tolist():
            f, n = first[k - 1], int(count[k]) - 1 + LONG
            if b.bytes[at[f] : at[f] + n] == b.bytes[at[k] : at[k] + n]:
                first[k], kind[k] = f, 1
        same = (doc[row] == doc[row[first]]) & (tie[row] == tie[row[first]]) & (seq[row] == seq[row[first]]) & (start == start[first])
        keep = (kind == 0) | ~same  # else a repeated row
        kind, key, row, start, count = kind[keep], key[keep], row[keep], start[keep], count[keep]
        # Anchors that occur again among what is not settled: one row goes out, and all are marked.
        k = np.flatnonzero(kind == 0)
        again = key[k][1:] == key[k][:-1]
        shared = np.concatenate([[False], again]) | np.concatenate([again, [False]]) if len(k) else np.zeros(0, bool)
        lone = k[~np.concatenate([[False], again])] if len(k) else k
        kind[k[shared]] = 2
        every = np.concatenate([np.arange(len(kind))[kind > 0], lone])
        kinds = np.concatenate([kind[kind > 0], np.zeros(len(lone), np.int32)])
        row, start, count, key = row[every], start[every], count[every], key[every]
        yield pa.record_batch([pa.array(key), pa.array(seq[row]), pa.array(doc[row]), pa.array(tie[row]), pa.array(pack(start, count)), pa.array(kinds)], ["key", "seq", "doc", "tie", "place", "kind"])


def shared_anchors(batches):
    """Rows sorted by key: of kind 0, those whose key another one has too, as kind 2; all others."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.column("kind").to_numpy()
        if kind.any():
            yield b.filter(pa.array(kind > 0))
            b = b.filter(pa.array(kind == 0))
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        again = np.concatenate([[False], key[1:] == key[:-1]])
        # The last row waits for the next one; if it is known already it is held again, and sent twice.
        pick = b.filter(pa.array(again | np.concatenate([again[1:], [False]])))
        held = b.slice(b.num_rows - 1)
        yield pa.record_batch([*(pick.column(c) for c in ("key", "seq", "doc", "tie", "place")), pa.array([2] * pick.num_rows, pa.int32())], b.schema.names)


STRETCH = "key long, seq long, doc long, tie long, anchor long, left int, low int, bytes binary"
PLAIN = bytes([255, *range(1, 256)])  # 255 does not occur in UTF-8, and stands for zero


def fetch(batches):
    """The bytes of the stretches that are asked for, and how many of them lie before the anchor."""
    for (seq, doc, tie, asked), b, offset in blocks(batches, ["seq", "doc", "tie", "asked"]):
        row, at, count, anchor = b.stretches()
        wanted = asked.to_pylist()
        own = np.array([k for k, w in enumerate(wanted) for _ in w], np.int64)
        place, key, hot = (np.array([x[c] for w in wanted for x in w], np.int64) for c in ("place", "key", "hot"))
        start = unpack(place)[0] - offset[own] + b.base[own]
        code, want = (row << 32) | at, (own << 32) | start
        k = np.minimum(np.searchsorted(code, want), max(0, len(code) - 1))
        here = np.flatnonzero(code[k] == want) if len(code) else np.zeros(0, int)  # else in another block of the text
        k, own, key, hot = k[here], own[here], key[here], hot[here]
        left, low = anchor[k] - at[k], anchor[k] - at[k] - count[k] + 1
        raws = [b.bytes[s : s + n].translate(PLAIN) for s, n in zip(at[k].tolist(), (count[k] - 1 + LONG).tolist())]
        # Hot anchors: once for each group of places that the stretch has.
        line, group = np.arange(len(k)), np.full(len(k), -1)
        some = np.flatnonzero(hot)
        many = left[some] // GROUP - low[some] // GROUP + 1
        of = np.repeat(some, many)
        line = np.concatenate([line[hot == 0], of])
        group = np.concatenate([group[hot == 0], np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of] // GROUP])
        near, far = group * GROUP, group * GROUP + GROUP - 1
        cold = group < 0
        mid = anchor[k][line]
        name = mixed(b.hashes(np.where(cold, 0, mid - near), np.where(cold, 0, mid + LONG - far), 6) + group.astype(np.uint64), 8).view(np.int64)
        own = own[line]
        columns = [np.where(cold, key[line], key[line] ^ name), seq.to_numpy()[own], doc.to_numpy()[own], tie.to_numpy()[own], mid - b.base[own] + offset[own]]
        high = np.where(cold, left[line], np.minimum(left[line], far))
        least = np.where(cold, low[line], np.maximum(low[line], near))
        cut = left[line] - high  # bytes of the stretch that strings of this group do not reach
        bytes_ = [raws[x][c : c + h - m + LONG] for x, c, h, m in zip(line.tolist(), cut.tolist(), high.tolist(), least.tolist())]
        yield pa.record_batch([*map(pa.array, columns), pa.array(high, pa.int32()), pa.array(least, pa.int32()), pa.array(bytes_, pa.binary())], ["key", "seq", "doc", "tie", "anchor", "left", "low", "bytes"])


RANGES = "seq long, doc long, tie long, first long, last long"  #: bytes first to last, the last exclusive


def common_prefixes(a: np.ndarray) -> np.ndarray:
    """Of each string and the one before it, padded strings of one width in order."""
    m = a.view(np.uint8).reshape(len(a), a.dtype.itemsize)
    other = m[1:] != m[:-1]
    return np.where(other.any(1), other.argmax(1), a.dtype.itemsize)


@dataclass
class Suffixes:
    """Suffixes at anchors: the bytes from the anchor on, those before it (nearest first), and the
    places (bytes before the anchor) of the strings that each stands for."""

    right: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self):
        return len(self.right)

    def take(self, k) -> Suffixes:
        return Suffixes(self.right[k], self.left[k], self.low[k], self.high[k])

    def merged(self, other: Suffixes) -> Suffixes:
        """Two arrays in order of `right` made one."""
        at = np.searchsorted(self.right, other.right, "right")
        both = lambda x, y: np.insert(x, at, y)
        return Suffixes(both(self.right, other.right), both(self.left, other.left), both(self.low, other.low), both(self.high, other.high))


class Family:
    """Suffix arrays of the batches so far; their sizes fall geometrically."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    def add(self, batch: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Takes a batch in document order. Returns, for each suffix, the greatest and least place of
        its strings that occur earlier; -1 and beyond all for none."""
        order = np.argsort(batch.right, kind="stable")
        own = batch.take(order)  # the suffix array of the batch
        heads = own.right.astype(f"S{ANCHOR}")
        known, partner = None, np.concatenate([[False], heads[1:] == heads[:-1]])[: len(own)]
        partner = partner | np.append(partner[1:], False)[: len(own)]
        for level in self.levels:
            there = level.right.astype(f"S{ANCHOR}")
            a, z = np.searchsorted(there, heads, "left"), np.searchsorted(there, heads, "right")
            partner |= z > a
            hit = np.zeros(len(level) + 1, np.int64)
            np.add.at(hit, a, 1)
            np.add.at(hit, z, -1)
            part = level.take(np.cumsum(hit[:-1]) > 0)
            known = part if known is None else known.merged(part)
        k = order[partner]
        most, least, times = np.full(len(batch), -1), np.full(len(batch), SPREAD), np.zeros(len(batch), np.int64)
        if len(k):
            self.scan(known, batch, own.take(partner), k, most, least, times)
        # What occurs earlier as a whole need not be kept.
        kept = own.take((times < batch.high - batch.low + 1)[order])
        self.levels.append(kept)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merged(last))
        return most, least

    @staticmethod
    def scan(known, batch, array, k, most, least, times):
        """Merges the batch's array with the known suffixes; k are the places of its rows in the
        batch. Fills in what occurs earlier."""
        old = 0 if known is None else len(known)
        if old:
            at = np.searchsorted(known.right, array.right, "right")
            right = np.insert(known.right, at, array.right)
            who = np.insert(np.arange(old), at, old + np.arange(len(k)))
        else:
            right, who = array.right, np.arange(len(k))
        # Rows: the known ones, then the batch's in document order.
        later = np.argsort(np.argsort(k))
        who = np.where(who < old, who, old + later[np.maximum(who - old, 0)])
        ordered = np.sort(k)
        own = batch.take(ordered)
        both = lambda x, y: np.concatenate([x, y]) if old else y
        left, low, high = (both(getattr(known, c, None), getattr(own, c)) for c in ("left", "low", "high"))
        n = old + len(k)
        to_right = common_prefixes(right)
        by_left = np.argsort(left, kind="stable")
        to_left = common_prefixes(left[by_left])
        rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
        for place in range(SPREAD):
            here = np.flatnonzero((low <= place) & (place <= high))
            if not len(here) or here[-1] < old:
                continue
            rank_r[who] = np.concatenate([[0], np.cumsum(to_right < LONG - place)])
            rank_l[by_left] = np.concatenate([[0], np.cumsum(to_left < place)])
            code = rank_r[here] * n + rank_l[here]  # equal for equal strings
            order = np.argsort(code, kind="stable")
            again = here[order[1:][code[order][1:] == code[order][:-1]]]
            again = ordered[again[again >= old] - old]
            most[again] = np.maximum(most[again], place)
            least[again] = np.minimum(least[again], place)
            times[again] += 1


def match(batches):
    """Ranges that strings with an earlier equal one cover. Rows come in document order."""
    family, held = Family(), []

    def run():
        seq, doc, tie, anchor, left, low = (np.array([h[k] for h in held], np.int64) for k in range(6))
        raws = [h[6] for h in held]
        right = np.array([r[x : x + LONG] for r, x in zip(raws, left.tolist())], f"S{LONG}")
        before = np.array([r[:x][::-1] for r, x in zip(raws, left.tolist())], f"S{SPREAD - 1}")
        held.clear()
        # Repeated rows are one document: all but the first of a place go.
        new = np.concatenate([[True], (seq[1:] != seq[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (low[1:] != low[:-1])])
        seq, doc, tie, anchor = seq[new], doc[new], tie[new], anchor[new]
        most, least = family.add(Suffixes(right[new], before[new], low[new], left[new]))
        k = most >= 0
        return pa.record_batch([pa.array(x) for x in (seq[k], doc[k], tie[k], anchor[k] - most[k], anchor[k] - least[k] + LONG)], ["seq", "doc", "tie", "first", "last"])

    last = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("seq", "doc", "tie", "anchor", "left", "low", "bytes", "key"))):
            if row == last:
                continue
            last = row
            held.append(row)
            if len(held) >= BATCH:
                yield run()
    if held:
        yield run()


def document(key: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(key.cast("long"), F.lit(-(2**63))), F.xxhash64(text)


def texts_of(docs: DataFrame, key: str, text: str, seq: int) -> DataFrame:
    doc, tie = document(F.col(key), F.col(text))
    rows = docs.select(F.lit(seq).cast("long").alias("seq"), doc.alias("doc"), tie.alias("tie"), F.col(text).alias("text"))
    return rows.where(F.octet_length("text") >= LONG)


def repeated(rows: DataFrame, own: DataFrame, seq: int = 0, old: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """rows: seq, doc, tie, text of all batches; own: the posts of batch seq, the newest, old: those
    of the others. Returns the byte ranges of the newest that repeat; they may overlap."""
    named = rows.select("seq", "doc", "tie", F.octet_length("text").cast("long").alias("last"), F.unhex(F.sha2("text", 256)).alias("name"))
    first = named.groupBy("name").agg(F.min(F.struct("seq", "doc")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stored(named.join(first, "name").where(F.struct("seq", "doc") > F.col("first")).select("seq", "doc", "tie", F.lit(0).cast("long").alias("first"), "last").distinct(), "copies")
    out = own if old is None else own.unionByName(old.withColumn("kind", F.lit(0)))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    by = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.xxhash64("doc", "place"))
    marks = stored(dealt(out, size // 40, POSTS_A_TASK, by).sortWithinPartitions("key").mapInArrow(shared_anchors, POST), "marks")
    need = marks.where("kind = 2").join(copies.select("seq", "doc", "tie"), ["seq", "doc", "tie"], "left_anti").select("key", "seq", "doc", "tie", "place").distinct()
    # Anchors of one row, or of old rows only, are done.
    many = need.groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("newest")).where((F.col("n") > 1) & (F.col("newest") == seq))
    asked = need.join(many.select("key", (F.col("n") > hot).cast("int").alias("hot")), "key")
    asked = stored(asked.groupBy("seq", "doc", "tie").agg(F.collect_list(F.struct("key", "place", "hot")).alias("asked")), "asked")  # at most one document's stretches
    fetched = asked.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]
    got = rows.join(asked.hint("shuffle_hash"), ["seq", "doc", "tie"]).select("seq", "doc", "tie", "asked", "text").mapInArrow(fetch, STRETCH)
    partial = dealt(got, fetched, ROWS_A_TASK, "key").sortWithinPartitions("seq", "doc", "tie", "anchor", "left", "low").mapInArrow(match, RANGES)
    partial = stored(partial.where(F.col("seq") == seq), "ranges")
    drop_stored(asked)
    return partial.unionByName(ranges_of(marks.where("kind = 1"))).unionByName(copies.where(F.col("seq") == seq))


CUT = "struct<kept:binary,removed:bigint,spans:bigint>"


def cut_out(docs: DataFrame, ranges: DataFrame, key: str, text: str, to: str) -> DataFrame:
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for raw, rs in zip(texts.cast(pa.binary()).to_pylist(), ranges.to_pylist()):
            raw, runs = raw or b"", []
            for r in sorted((r["first"], r["last"]) for r in rs or ()):
                if runs and r[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], r[1])
                else:
                    runs.append(list(r))
            kept, at = [], 0
            for a, z in runs:
                kept.append(raw[at:a])
                at = z
            out.append({"kept": b"".join([*kept, raw[at:]]), "removed": sum(z - a for a, z in runs), "spans": len(runs)})
        return pa.array(out, pa.struct([("kept", pa.binary()), ("removed", pa.int64()), ("spans", pa.int64())]))

    own = [fresh(docs, c) for c in ("_doc", "_tie", "_ranges")]
    found = ranges.groupBy("doc", "tie").agg(F.collect_set(F.struct("first", "last")).alias(own[2])).withColumnsRenamed({"doc": own[0], "tie": own[1]})
    doc, tie = document(F.col(key), F.col(text))
    joined = docs.withColumn(own[0], doc).withColumn(own[1], tie).join(found.hint("shuffle_hash"), own[:2], "left")
    return joined.withColumn(to, cut(F.col(text), F.col(own[2]))).select(*(c for c in docs.columns if c != to), to)


def ranges_of(posts_: DataFrame) -> DataFrame:
    start = F.shiftright("place", COUNT_BITS)
    return posts_.select("seq", "doc", "tie", start.alias("first"), (start + F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) + LONG).alias("last"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", to: str = "cut", hot: int = HOT) -> DataFrame:
    """Adds `to`: the kept bytes, the number of removed ones and of maximal removed runs."""
    rows = texts_of(docs, key, text, 0)
    return cut_out(docs, repeated(rows, rows.mapInArrow(posts, POST), hot=hot), key, text, to)


@dataclass
class Level:
    posts: str
    texts: str
    batches: int


class Index:
    """Anchors and texts of all batches so far, below a folder that all executors share. Batches are
    levels; two levels of equal numbers of batches merge into one, sorted by anchor. A new Index of the
    same folder goes on where the last one ended."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.levels = spark, folder.rstrip("/"), []
        self.manifest = f"{self.folder}/manifest"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.manifest)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            lines = spark.read.parquet(self.manifest)
            last = lines.agg(F.max("batch")).first()[0]
            self.levels = [Level(r["posts"], r["texts"], r["batches"]) for r in lines.where(F.col("batch") == last).orderBy("at").collect()]

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", to: str = "cut", hot: int = HOT) -> DataFrame:
        """Takes a batch; returns it with `to` as `remove` does, against itself and all earlier ones."""
        read = self.spark.read.parquet
        seq = sum(x.batches for x in self.levels)
        rows = texts_of(docs, key, text, seq)
        own = stored(rows.mapInArrow(posts, POST), "posts")
        every, old = rows, None
        for x in self.levels:
            every = every.unionByName(read(x.texts))
            old = read(x.posts) if old is None else old.unionByName(read(x.posts))
        found = repeated(every, own, seq, old, hot)
        anchors = own.where("kind <> 1").drop("kind").distinct()
        self.levels.append(Level(self._write(anchors.sortWithinPartitions("key"), "posts"), self._write(rows.distinct(), "texts"), 1))
        while len(self.levels) > 1 and self.levels[-2].batches <= self.levels[-1].batches:
            b, a = self.levels.pop(), self.levels.pop()
            both = lambda p, q: read(p).unionByName(read(q))
            self.levels.append(Level(self._write(both(a.posts, b.posts).repartition("key").sortWithinPartitions("key"), "posts"), self._write(both(a.texts, b.texts), "texts"), a.batches + b.batches))
        lines = [(seq + 1, k, x.posts, x.texts, x.batches) for k, x in enumerate(self.levels)]
        self.spark.createDataFrame(lines, "batch int, at int, posts string, texts string, batches int").write.mode("append").parquet(self.manifest)
        drop_stored(own)
        return cut_out(docs, found, key, text, to)
