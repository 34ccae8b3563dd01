"""Ranked lexical search: an index of posting blocks in files, searched by Block-Max WAND.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. A term's weight and a document's score are whole numbers (`weight`, `impacts`), so results
do not depend on how the corpus is split.

The index. A task cuts its documents into segments of bounded text and writes one row for each segment
and term: postings (gaps of document numbers, occurrences; variable-byte coded) in blocks of BLOCK, and
beside them a head for each block with its first and last document, where its bytes start, and the
greatest impact in it, weight apart. One further row a segment holds ids and lengths. Documents are not
shuffled. All terms are indexed, so that other items can be searched later without another scan.

The search. Items go in blocks of bounded size; rows of their terms alone are read. For an item and a
segment, block heads (no postings) give a bound for every stretch of documents between block borders:
the sum of greatest impacts of the blocks that span it. Stretches below the 50th best score so far are
skipped, and blocks that only lie in skipped stretches are never decompressed. In the others, pivots
are documents in the lists of those terms without which the threshold is out of reach; of the other
terms, only blocks around pivots that can still reach it are decompressed. The threshold is carried from
segment to segment of a task, and from a first share of the segments to all others. Documents that could
tie are kept, so the ranks are exact.

Null texts, texts without terms and items without terms match nothing. Equal scores go by ascending
doc_id, null ids last; repeated rows are documents of their own. Repeated items are searched once each,
and a null item_id is an item as any other. An empty table gives no rows. A text of any length is one document, read
in pieces; a segment holds one at least. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, tidy

BEST, BLOCK = 50, 128
#: Text of a segment in bytes, and its documents at most (one text may be longer).
SEGMENT_BYTES, SEGMENT_ROWS = 8 << 20, 1 << 16
#: Items, and bytes of their texts, that are searched in one pass over the index.
ITEMS, ITEM_BYTES = 2000, 2 << 20
#: Bytes of index rows that one task of a search reads at most, as a rule.
TASK_BYTES = 64 << 20
#: One segment in so many is searched first, for the thresholds.
FIRST = 16
_PIECE = 1 << 16
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = "segment long, term string, rows long, heads binary, postings binary, ids array<long>"
_HEAD = 4  # first and last document, start of the block's bytes, greatest impact


def pieces(text: str | None):
    """Terms of a text, in lists of bounded size."""
    rest = text.encode().translate(_TO_TERMS) if text else b""
    while rest:
        words = rest.split(None, _PIECE)
        rest = words.pop() if len(words) > _PIECE else b""
        if words:
            yield words


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to the scores of documents, its weight apart."""
    m = 50 + 50 * length * n // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def vbyte(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2^35 in bytes of seven bits, the last byte of each marked; and their sizes."""
    size = 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[at[more] + k] = x[more] >> 7 * k & 127
    out[at + size - 1] |= 128
    return out, size


def unvbyte(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw & 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts) if len(ends) else np.zeros(0, np.int64)


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Cells of one buffer that end at `ends`."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


class _Segment:
    """Documents of one segment while it is filled."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.keys, self.ids, self.lengths, self.bytes = [], [], [], 0

    def add(self, doc_id, text):
        doc, length = len(self.ids), 0
        for words in pieces(text):
            terms = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            self.keys.append(terms << 32 | doc)
            length += len(words)
        self.bytes += len(text)
        self.ids.append(doc_id)
        self.lengths.append(length)

    def rows(self, segment: int, n: int, total: int) -> pa.RecordBatch:
        key = np.concatenate(self.keys)
        self.keys.clear()
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf, key = np.diff(np.append(new, len(key))), key[new]
        term, doc, length = key >> 32, key & 0xFFFFFFFF, np.array(self.lengths, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # of terms
        df = np.diff(np.append(starts, len(term)))
        place = np.arange(len(term)) - np.repeat(starts, df)
        block = np.flatnonzero(place % BLOCK == 0)
        last = np.append(block[1:], len(term)) - 1
        gap = np.diff(doc, prepend=0)
        gap[block] = 0
        raw, size = vbyte(np.column_stack([gap, tf]).ravel())
        ends = np.cumsum(size)[1::2]  # of postings
        most = np.maximum.reduceat(impacts(tf, length[doc], n, total), block)
        term_start = np.concatenate([[0], ends[starts[1:] - 1]])
        block_start = np.concatenate([[0], ends[block[1:] - 1]]) - np.repeat(term_start, -(-df // BLOCK))
        heads = np.column_stack([doc[block], doc[last], block_start, most]).astype(np.int32)
        names = list(self.numbers)
        cells = [
            pa.array(np.full(len(df) + 1, segment)),
            pa.array([names[t].decode() for t in term[starts].tolist()] + [""], pa.string()),
            pa.array(np.append(df, len(length))),
            _binary(np.concatenate([heads.view(np.uint8).ravel(), length.astype(np.int32).view(np.uint8)]), np.append(np.cumsum(-(-df // BLOCK)) * 4 * _HEAD, heads.nbytes + 4 * len(length))),
            _binary(raw, np.append(ends[starts + df - 1], len(raw))),
            pa.array([None] * len(df) + [self.ids], pa.list_(pa.int64())),
        ]
        return pa.record_batch(cells, ["segment", "term", "rows", "heads", "postings", "ids"])


def _counted(batches):
    n = total = 0
    for b in batches:
        for text in b.column("text"):
            length = sum(map(len, pieces(text.as_py())))
            n, total = n + (length > 0), total + length
    yield pa.record_batch([pa.array([n]), pa.array([total])], ["n", "total"])


class Index:
    """Posting blocks of all documents, in a stored table. The greatest impacts depend on the number and
    the lengths of all documents, so another corpus is another index."""

    def __init__(self, docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, segment_rows: int = SEGMENT_ROWS):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        size = docs.select("text").mapInArrow(_counted, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
        self.n, self.total = n, total = size[0] or 0, size[1] or 0

        def build(batches):
            task, made, part = TaskContext.get().partitionId(), 0, _Segment()
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    part.add(doc_id, text.as_py())
                    if part.bytes >= segment_bytes or len(part.ids) >= segment_rows:
                        yield from _cut(part.rows(task << 32 | made, n, total))
                        made, part = made + 1, _Segment()
            if part.keys:
                yield from _cut(part.rows(task << 32 | made, n, total))
            del part
            tidy()

        self.rows = stored(docs.where(F.length("text") > 0).mapInArrow(build, _INDEX), "postings")

    def drop(self) -> None:
        drop_stored(self.rows)

    def search(self, items: DataFrame, best: int = BEST) -> DataFrame:
        """items has item_id and text. item_id, rank, doc_id and score of the best documents of each."""
        out = self.rows.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        block, size = [], 0
        for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
            block.append((r["item_id"], sorted({w.decode() for words in pieces(r["text"]) for w in words})))
            size += len(r["text"] or "")
            if len(block) >= ITEMS or size >= ITEM_BYTES:
                out, block, size = out.unionByName(self._search(block, best)), [], 0
        return out.unionByName(self._search(block, best)) if block else out

    def _search(self, items: list[tuple[int | None, list[str]]], best: int) -> DataFrame:
        spark = self.rows.sparkSession
        terms = sorted({t for _, words in items for t in words} | {""})
        wanted = self.rows.join(F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
        wanted = stored(wanted, "wanted")
        sums = wanted.groupBy("term").agg(F.sum("rows").alias("df"), F.sum(F.octet_length("heads") + F.octet_length("postings")).alias("bytes")).collect()
        weights = {r["term"]: weight(self.n, r["df"]) for r in sums if r["term"]}
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["bytes"] for r in sums) // TASK_BYTES))
        queries = [[(t, weights[t]) for t in words if weights.get(t, 0) > 0] for _, words in items]
        first = F.pmod(F.xxhash64("segment"), F.lit(FIRST)) == 0
        found = [stored(_scanned(wanted.where(first), queries, [1] * len(items), best, self.n, self.total, tasks), "found")]
        least = [1] * len(items)
        for r in _ranked(found[0], best).where(F.col("rank") == best).collect():
            least[r["item"]] = r["score"]
        found.append(stored(_scanned(wanted.where(~first), queries, least, best, self.n, self.total, tasks), "found"))
        names = F.broadcast(spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(items)], "item int, item_id long"))
        ranked = stored(_ranked(found[0].unionByName(found[1]), best).join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        drop_stored(wanted, *found)
        return ranked


def _cut(rows: pa.RecordBatch, size: int = 1 << 14):
    for at in range(0, rows.num_rows, size):
        yield rows.slice(at, size)


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _scanned(rows: DataFrame, queries, least, best: int, n: int, total: int, tasks: int) -> DataFrame:
    """item (number), doc_id, score: for each task and item the best of the task's segments that reach
    `least`."""

    def scan(batches):
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        floor = list(least)
        for postings, lengths, ids in _segments(batches):
            for k, query in enumerate(queries):
                here = [(w, *postings[t]) for t, w in query if t in postings]
                if not here:
                    continue
                docs, scores = block_max(here, lengths, floor[k], best, n, total)
                if len(docs):
                    scores, docs = np.concatenate([kept[k][0], scores]), np.concatenate([kept[k][1], ids[docs]])
                    order = np.lexsort((docs, -scores))[:best]
                    kept[k] = scores[order], docs[order]
                    if len(order) == best:
                        floor[k] = max(floor[k], int(scores[order[-1]]))
        item = np.repeat(np.arange(len(queries)), [len(s) for s, _ in kept])
        docs = np.concatenate([d for _, d in kept]) if len(kept) else np.zeros(0, np.int64)
        scores = np.concatenate([s for s, _ in kept]) if len(kept) else docs
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(docs, mask=docs == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])
        tidy()

    return rows.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(scan, "item int, doc_id long, score long")


#: Stands for a null id within a task, and sorts after all ids.
NO_ID = np.iinfo(np.int64).max


def _segments(batches):
    """(term: heads and postings), lengths and ids of one segment after the other."""
    at, postings, lengths, ids = None, {}, None, None
    for b in batches:
        cells = [b.column(c) for c in ("segment", "term", "heads", "postings", "ids")]
        for segment, term, heads, raw, own in zip(cells[0].to_pylist(), cells[1].to_pylist(), *cells[2:]):
            if segment != at:
                if at is not None:
                    yield postings, lengths, ids
                at, postings = segment, {}
            head = np.frombuffer(heads.as_buffer(), np.int32).astype(np.int64)
            if term:
                postings[term] = head.reshape(-1, _HEAD), np.frombuffer(raw.as_buffer(), np.uint8)
            else:
                lengths, ids = head, own.values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    if at is not None:
        yield postings, lengths, ids


class _Stretches:
    """Bounds of the stretches between block borders, from block heads alone."""

    def __init__(self, terms):
        first, after = np.concatenate([t.heads[:, 0] for t in terms]), np.concatenate([t.heads[:, 1] + 1 for t in terms])
        self.borders = np.unique(np.concatenate([first, after]))

    def bound(self, terms) -> np.ndarray:
        """For each stretch the most that these terms can add to a document in it."""
        change = np.zeros(len(self.borders), np.int64)
        for t in terms:
            np.add.at(change, np.searchsorted(self.borders, t.heads[:, 0]), t.most)
            np.subtract.at(change, np.searchsorted(self.borders, t.heads[:, 1] + 1), t.most)
        return np.cumsum(change)

    def of(self, docs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, docs, "right") - 1


class _Term:
    def __init__(self, weight: int, heads: np.ndarray, raw: np.ndarray):
        self.weight, self.heads, self.raw = weight, heads, raw
        self.most = weight * heads[:, 3]
        self.stop = np.append(heads[1:, 2], len(raw))

    def read(self, wanted: np.ndarray, corpus) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these blocks, and what the term adds to them."""
        lengths, n, total = corpus
        raw = self.raw if len(wanted) == len(self.heads) else np.concatenate([self.raw[self.heads[j, 2] : self.stop[j]] for j in wanted.tolist()])
        pairs = unvbyte(raw).reshape(-1, 2)
        docs = np.cumsum(pairs[:, 0])
        at = np.arange(0, len(docs), BLOCK)  # all blocks but a term's last are full
        docs += np.repeat(self.heads[wanted, 0] - docs[at], np.diff(np.append(at, len(docs))))
        return docs, self.weight * impacts(pairs[:, 1], lengths[docs], n, total)

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Blocks that reach into one of the ascending stretches from `low` to before `high`."""
        k = np.searchsorted(high, self.heads[:, 0], "right")
        return np.flatnonzero((k < len(low)) & (low[np.minimum(k, len(low) - 1)] <= self.heads[:, 1]))


def _added(terms, docs: np.ndarray, corpus) -> np.ndarray:
    """What the terms add to the ascending documents; other blocks than theirs stay packed."""
    sums = np.zeros(len(docs), np.int64)
    for t in terms:
        wanted = t.within(docs, docs + 1)
        if len(wanted):
            found, parts = t.read(wanted, corpus)
            k = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[k] == found
            sums[k[hit]] += parts[hit]
    return sums


def _union(terms, wanted, corpus, stretches=None, live=None) -> tuple[np.ndarray, np.ndarray]:
    """Documents (of live stretches) that the wanted blocks of the terms hold, and their sums."""
    read = [t.read(w, corpus) for t, w in zip(terms, wanted) if len(w)]
    if not read:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, parts = (np.concatenate(x) for x in zip(*read))
    if live is not None:
        inside = live[stretches.of(docs)]
        docs, parts = docs[inside], parts[inside]
    docs, place = np.unique(docs, return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, place, parts)
    return docs, sums


def block_max(terms, lengths: np.ndarray, least: int, best: int, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment and their scores: all that reach both `least` and the best-th score.
    terms: weight, block heads and postings of each term of the item.

    The weakest terms whose greatest impacts together stay below the threshold cannot lift a document
    to it alone. So only documents in the lists of the others are candidates (the pivots), and a
    candidate is scored in full only if its sum there and the block maxima of the weak terms around it
    reach the threshold."""
    corpus = lengths, n, total
    terms = sorted((_Term(*t) for t in terms), key=lambda t: -int(t.most.max()))
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if least <= 1:  # no threshold yet: the likeliest documents of the strongest terms give one
        few = 1 + next((k for k, rows in enumerate(np.cumsum([len(t.heads) for t in terms]) * BLOCK) if rows >= 2 * best), len(terms))
        seeds, sums = _union(terms[:few], [np.arange(len(t.heads)) for t in terms[:few]], corpus)
        seeds = np.sort(seeds[np.argsort(-sums, kind="stable")[: 2 * best]])
        reached = _added(terms, seeds, corpus)
        if len(reached) >= best:
            least = max(least, int(np.partition(reached, len(reached) - best)[len(reached) - best]))
    stretches = _Stretches(terms)
    live = stretches.bound(terms) >= least
    at = np.flatnonzero(live)
    if not len(at):
        return docs, scores
    low, high = stretches.borders[at], stretches.borders[np.minimum(at + 1, len(stretches.borders) - 1)]
    weak = len(terms) - int(np.searchsorted(np.cumsum([int(t.most.max()) for t in reversed(terms)]), least))
    strong, rest = terms[:weak], terms[weak:]
    pivots, sums = _union(strong, [t.within(low, high) for t in strong], corpus, stretches, live)
    bound = sums + stretches.bound(rest)[stretches.of(pivots)] if len(pivots) else sums
    for likely in (True, False):
        keep = bound >= least
        pivots, sums, bound = pivots[keep], sums[keep], bound[keep]
        chosen = np.ones(len(pivots), bool)
        if likely and len(pivots) > 4 * best:
            chosen = bound >= np.partition(bound, len(bound) - 2 * best)[len(bound) - 2 * best]
        mine = pivots[chosen]
        if len(mine):
            reached = sums[chosen] + _added(rest, mine, corpus)
            docs, scores = np.concatenate([docs, mine]), np.concatenate([scores, reached])
            if len(scores) >= best:
                least = max(least, int(np.partition(scores, len(scores) - best)[len(scores) - best]))
        pivots, sums, bound = pivots[~chosen], sums[~chosen], bound[~chosen]
    keep = scores >= least
    return docs[keep], scores[keep]
