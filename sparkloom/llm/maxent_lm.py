"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history). Words are told apart by 64-bit
hashes, and every word, however rare, has a history of its own.

Class factor: a softmax whose logits are sums of weight rows picked by hashed features: the last
word, the last two, the one before last (a skip) and the one before that with the last (a longer
skip). Classes are bands of equal mass of the `head` most frequent words, and one for all others.
Word factor: a softmax over the words of the class with a bias for each word, which is the log of its
count, and a weight for each hashed bigram, that is the word with the bucket of the word before it.
Only bigrams of the corpus have weights, so the sum over a class is its plain sum and a correction.
This table has a row for each word of the corpus and grows with it; it is shuffled by word, and words
outside the head meet it in a join. Only the head's rows and the class weights, of fixed size, are
broadcast.

Training is by synchronous gradient steps: tasks send the observed and expected counts of features as
whole numbers, which have one sum in any order; each step moves a weight by the gradient over the
larger of both. The class factor takes `rounds` steps, each over other rows, by a hash of the row;
so all training rows are used once. The word factor takes two over the table of all bigrams. Thus
the model does not depend on how rows are split over tasks.

Null text counts as empty: it has the end token only. Repeated rows get equal scores and count as
often as they occur. A row whose `training` is null is neither learned from nor held out. Without
training rows all words are unseen. Ties in the ranking of words go by hash. Other columns do not
matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICED, dealt, least_reaching, sliced, sliced_sum, stored
from .jaccard_join import LOWER, mixed, names, pieces

HEAD = 1 << 17
CLASSES = 16
ROWS = 1 << 14  #: of class weights
BUCKETS = 64  #: of the word before
ROUNDS, RATE = 3, 0.7
WORD_RATE, UNIT = 2.0, 31  #: step of a word weight; its whole-number steps to one
FIXED = 1 << 20  #: an expected count of one
COUNT_TOKENS = 1_500_000
TASK_BYTES = 64 << 20  #: of text whose words one task adds up
START, END = np.uint64(0), np.uint64(1)
OTHER = CLASSES - 1


def tokens(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text followed by the end token, and the sizes of the texts."""
    lines = [b" ".join((r or b"").translate(LOWER).split()) for r in raws]
    flat = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    ends = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    words = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    slots = np.maximum(words, 1)  # an empty line leaves a blank of its own
    out = np.full(int(words.sum()) + len(words), END)
    row = np.repeat(np.arange(len(words)), slots)
    real = words[row] > 0
    at = np.arange(len(row)) - np.repeat(np.cumsum(slots) - slots, slots) + (np.cumsum(words + 1) - words - 1)[row]
    out[at[real]] = names(flat, starts, ends, 21)[real]
    return out, words + 1


def before(h: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k-th token before each, within its text."""
    begin = np.cumsum(sizes) - sizes
    out = np.full(len(h), START)
    out[k:] = h[:-k]
    for j in range(k):  # places that are nearer to the start of their text
        out[begin[sizes > j] + j] = START
    return out


def bucket(previous: np.ndarray) -> np.ndarray:
    return (mixed(previous, 41) >> np.uint64(58)).astype(np.int64)


def class_rows(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The weight rows of each token's history, one line for each family of features."""
    a, b, c = (before(h, sizes, k) for k in (1, 2, 3))
    names = (a, mixed(b, 5) + a, b, mixed(c, 7) + a)
    return np.stack([(mixed(x, 11 + k) >> np.uint64(50)).astype(np.int64) for k, x in enumerate(names)])


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Row k holds data[offsets[k]:offsets[k + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def entries(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of `binaries`, and to which row each belongs."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(col.buffers()[2], kind, (offsets[-1] - offsets[0]) // size, offsets[0]) if len(col) and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return values, np.repeat(np.arange(len(col)), np.diff(offsets) // size)


# Bigram counts of a word: the bucket in the upper eight bits, the count below.
WORDS = "h long, c long, bigrams binary"


def word_batches(h, c, owner, at, n, rows=50_000):
    """Words with their bigrams; owner, at and n are sorted by owner."""
    begin = np.searchsorted(owner, np.arange(len(h) + 1))
    packed = (at.astype(np.uint64) << np.uint64(56)) | n.astype(np.uint64)
    for s in range(0, len(h), rows):
        e = min(len(h), s + rows)
        yield pa.record_batch([pa.array(h[s:e].view(np.int64)), pa.array(c[s:e]), binaries(begin[s : e + 1] - begin[s], packed[begin[s] : begin[e]])], ["h", "c", "bigrams"])


def count_words(batches):
    """Words and bigrams, counted some million tokens at a time."""
    held, waiting = [], 0

    def flush():
        h, at = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        words, owner, c = np.unique(h, return_inverse=True, return_counts=True)
        codes, n = np.unique(owner * BUCKETS + at, return_counts=True)
        yield from word_batches(words, c, codes // BUCKETS, codes % BUCKETS, n)

    for _, raws in pieces(batches, ["text"]):
        h, sizes = tokens(raws)
        held.append((h, bucket(before(h, sizes, 1))))
        waiting += len(h)
        if waiting >= COUNT_TOKENS:
            yield from flush()
            waiting = 0
    if held:
        yield from flush()


def add_words(batches):
    """Adds up rows of equal words, which come one after the other."""
    last = None

    for b in batches:
        if not b.num_rows:
            continue
        h, c = b.column("h").to_numpy().view(np.uint64), b.column("c").to_numpy()
        values, owner = entries(b.column("bigrams"), np.uint64)
        at, n = (values >> np.uint64(56)).astype(np.int64), (values & np.uint64((1 << 56) - 1)).astype(np.int64)
        if last is not None:
            h, c = np.append(last[0], h), np.append(last[1], c)
            at, n, owner = np.concatenate([np.arange(BUCKETS), at]), np.concatenate([last[2], n]), np.concatenate([np.zeros(BUCKETS, int), owner + 1])
        new = np.concatenate([[True], h[1:] != h[:-1]])
        word, first = np.cumsum(new) - 1, np.flatnonzero(new)
        codes = word[owner] * BUCKETS + at
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
        codes, n = codes[start], np.add.reduceat(n, start) if len(start) else n
        h, c = h[first], np.add.reduceat(c, first)
        codes, n = codes[n > 0], n[n > 0]
        held = codes >= (len(h) - 1) * BUCKETS
        own = np.zeros(BUCKETS, np.int64)
        own[codes[held] % BUCKETS] = n[held]
        last = (h[-1], c[-1], own)
        codes, n = codes[~held], n[~held]
        yield from word_batches(h[:-1], c[:-1], codes // BUCKETS, codes % BUCKETS, n)
    if last is not None:
        own = np.flatnonzero(last[2])
        yield from word_batches(np.array([last[0]]), np.array([last[1]]), np.zeros(len(own), int), own, last[2][own])


class Vocabulary:
    """The head: its hashes in order, counts and classes; and the plain sums of all classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray, n: int, v: int):
        self.n, self.v = n, v
        rank = np.lexsort((h, -c))
        mass = np.cumsum(c[rank]) / max(1, c.sum())
        kind = np.empty(len(h), np.int64)
        kind[rank] = np.minimum((mass * OTHER).astype(int), OTHER - 1)
        order = np.argsort(h)
        self.h, self.c, self.kind = h[order], c[order], kind[order]
        rest, words = n - int(c.sum()), v - len(h)
        self.sums = np.bincount(self.kind, self.c + 0.5, CLASSES)
        self.sums[self.sums == 0] = 1.0  # of no word
        self.sums[OTHER] = rest + 0.5 * (words + 1)  # with one unseen word
        prior = np.bincount(self.kind, self.c, CLASSES)
        prior[OTHER] = rest
        self.bias = np.log((prior + 1) / (prior.sum() + CLASSES)).astype(np.float32)
        self.denominator = n + 0.5 * (v + 1)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each word is in the head, or its size for all others."""
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[k] == h, k, len(self.h))

    def kinds(self, places: np.ndarray) -> np.ndarray:
        return np.append(self.kind, OTHER)[places]


class WordFactor:
    """Bigram weights from counts: `seen` tokens of each class after each bucket, and the sums over
    each class and bucket before each step."""

    def __init__(self, vocabulary: Vocabulary, seen: np.ndarray):
        self.seen = seen.reshape(CLASSES, BUCKETS).astype(float)
        self.steps = [np.repeat(vocabulary.sums[:, None], BUCKETS, 1)]

    def weights(self, c, kind, at, n, steps: int) -> np.ndarray:
        """Whole-number weights of bigrams after some steps: of words of counts c, of classes kind,
        after buckets at, seen n times."""
        w = np.zeros(len(c))
        for sums in self.steps[:steps]:
            expected = self.seen[kind, at] * (c + 0.5) * np.exp(w / UNIT) / sums[kind, at]
            w = np.rint(w + UNIT * WORD_RATE * (n - expected) / (np.maximum(n, expected) + 1))
        return w


def table_rows(batches, vocabulary: Vocabulary):
    """Rows of the word table: hashes, counts, classes; and of their bigrams: row, bucket, count."""
    for b in batches:
        h, c = b.column("h").to_numpy().view(np.uint64), b.column("c").to_numpy()
        values, owner = entries(b.column("bigrams"), np.uint64)
        yield h, c, vocabulary.kinds(vocabulary.places(h)), owner, (values >> np.uint64(56)).astype(np.int64), (values & np.uint64((1 << 56) - 1)).astype(np.int64)


def word_factor(words: DataFrame, vocabulary) -> WordFactor:
    def seen(batches):
        total = np.zeros(CLASSES * BUCKETS, np.int64)
        for _, _, kind, owner, at, n in table_rows(batches, vocabulary.value):
            np.add.at(total, kind[owner] * BUCKETS + at, n)
        yield sliced(total)

    factor = WordFactor(vocabulary.value, sliced_sum(words.mapInArrow(seen, SLICED), CLASSES * BUCKETS))
    for k in (1, 2):

        def corrections(batches, factor=factor, k=k):
            total = np.zeros(CLASSES * BUCKETS, np.int64)
            for _, c, kind, owner, at, n in table_rows(batches, vocabulary.value):
                w = factor.weights(c[owner], kind[owner], at, n, k)
                np.add.at(total, kind[owner] * BUCKETS + at, np.rint(256 * (c[owner] + 0.5) * np.expm1(w / UNIT)).astype(np.int64))
            yield sliced(total)

        more = sliced_sum(words.mapInArrow(corrections, SLICED), CLASSES * BUCKETS).reshape(CLASSES, BUCKETS) / 256
        # A sum stays above that of the words without weights, whatever the rounding.
        factor.steps.append(np.maximum(factor.steps[0] + more, 1e-3 * factor.steps[0]))
    return factor


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = bias + weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    np.exp(z, z)
    z /= z.sum(1, keepdims=True)
    return z


def train_classes(rows: DataFrame, vocabulary, rounds: int) -> np.ndarray:
    """Class weights. rows: key, text."""
    sc = rows.sparkSession.sparkContext
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for turn in range(rounds):
        sent = sc.broadcast(weights)

        def gradient(batches, sent=sent):
            own, v = sent.value, vocabulary.value
            observed, expected = np.zeros(ROWS * CLASSES, np.int64), np.zeros((CLASSES, ROWS))
            for _, raws in pieces(batches, ["text"]):
                h, sizes = tokens(raws)
                kind, picked = v.kinds(v.places(h)), class_rows(h, sizes)
                observed += np.bincount((picked * CLASSES + kind).ravel(), minlength=len(observed))
                for s in range(0, len(h), 1 << 15):
                    r = picked[:, s : s + (1 << 15)]
                    p = np.rint(probabilities(own, v.bias, r) * FIXED)
                    for k in range(CLASSES):
                        expected[k] += np.bincount(r.ravel(), np.tile(p[:, k], len(r)), ROWS)
            yield sliced(np.concatenate([observed, expected.T.ravel().astype(np.int64)]))

        mine = rows.where(F.pmod(F.xxhash64("key", "text", F.lit(17)), F.lit(rounds)) == turn).select("text")
        got = sliced_sum(mine.mapInArrow(gradient, SLICED), 2 * ROWS * CLASSES).reshape(2, ROWS, CLASSES)
        observed, expected = got[0].astype(float), got[1] / FIXED
        weights = (weights + RATE * (observed - expected) / (np.maximum(observed, expected) + 4)).astype(np.float32)
        sent.unpersist()
    return weights


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", head_words: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """training: true for the rows to learn from, false for those held out. Returns key, held_out,
    n_tokens, n_known, train_tokens, base_score and score for each row, in log10."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), training.alias("train"))
    learn = rows.where("train").select("key", "text")
    counted = learn.select("text").mapInArrow(count_words, WORDS)
    size = learn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    words = stored(dealt(counted, size, TASK_BYTES, "h").sortWithinPartitions("h").mapInArrow(add_words, WORDS), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_reaching(words, "c", head_words)
    head, tail = words.where(F.col("c") >= least), words.where(F.col("c") < least)
    got = head.select("h", "c").toArrow()
    vocabulary = sc.broadcast(Vocabulary(got["h"].to_numpy().view(np.uint64), got["c"].to_numpy(), n, v))
    factor = word_factor(words, vocabulary)

    def weighted(batches):
        for h, c, kind, owner, at, n in table_rows(batches, vocabulary.value):
            w = factor.weights(c[owner], kind[owner], at, n, 2).astype(np.int8)
            begin = pa.array(np.searchsorted(owner, np.arange(len(h) + 1)), pa.int32())
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c), pa.MapArray.from_arrays(begin, pa.array(at, pa.int8()), pa.array(w))], ["h", "c", "w"])

    # The head's weights as a dense table, the others' for a join.
    table = np.zeros((len(vocabulary.value.h) + 1, BUCKETS), np.int8)
    for b in head.mapInArrow(weighted, "h long, c long, w map<tinyint,tinyint>").toArrow().to_batches():
        w = b.column("w")
        table[np.repeat(vocabulary.value.places(b.column("h").to_numpy().view(np.uint64)), np.diff(w.offsets.to_numpy())), w.keys.to_numpy()] = w.items.to_numpy()
    tail = tail.mapInArrow(weighted, "h long, c long, w map<tinyint,tinyint>")
    model = sc.broadcast((train_classes(learn, vocabulary, rounds), table))

    def run(batches):
        voc, (weights, bigram) = vocabulary.value, model.value
        norms = np.log10(factor.steps[2])
        inside = np.append(np.log10(voc.c + 0.5), 0.0)
        base = np.append(np.log10((voc.c + 0.5) / voc.denominator), 0.0)
        other = len(voc.h)
        for (row, train), raws in pieces(batches, ["row", "train", "text"]):
            h, sizes = tokens(raws)
            places, picked, at = voc.places(h), class_rows(h, sizes), bucket(before(h, sizes, 1))
            kind = voc.kinds(places)
            p = np.empty(len(h))
            for s in range(0, len(h), 1 << 15):
                q = probabilities(weights, voc.bias, picked[:, s : s + (1 << 15)])
                p[s : s + (1 << 15)] = np.log10(np.maximum(q[np.arange(len(q)), kind[s : s + (1 << 15)]], 1e-30))
            p += inside[places] + bigram[places, at] / (UNIT * math.log(10)) - norms[kind, at]
            doc = np.repeat(np.arange(len(raws)), sizes)
            total = lambda x: np.bincount(doc, x, len(raws))
            far = np.flatnonzero(places == other)
            many = np.bincount(doc[far], minlength=len(raws))
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.StructArray.from_arrays([pa.array(h[far].view(np.int64)), pa.array(at[far], pa.int8())], ["h", "at"]))
            yield pa.record_batch([row, train, pa.array(sizes), pa.array(sizes - many), pa.array(total(base[places])), pa.array(total(p)), others], ["row", "train", "n_tokens", "known", "base", "score", "others"])

    named = rows.select("train", "text", F.struct("key").alias("row"))
    kind = named.schema["row"].dataType.simpleString()
    scored = stored(named.mapInArrow(run, f"row {kind}, train boolean, n_tokens long, known long, base double, score double, others array<struct<h:bigint,at:tinyint>>"), "scored").withColumn("_id", F.monotonically_increasing_id())
    # Words outside the head: their counts and weights come by a join, and their parts of the sums by row.
    apart = scored.select("_id", F.explode("others").alias("o")).select("_id", "o.h", "o.at")
    c = F.coalesce("c", F.lit(0))
    weight = F.coalesce(F.try_element_at("w", F.col("at")), F.lit(0)) / (UNIT * math.log(10))
    met = apart.join(tail.hint("shuffle_hash"), "h", "left").groupBy("_id").agg(F.count_if(c > 0).alias("more"), F.sum(F.log10(c + 0.5)).alias("logs"), F.sum(weight).alias("weights"), F.count("*").alias("rest"))
    out = scored.drop("others").join(met, "_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return out.select(
        F.col("row.key").alias(key),
        F.coalesce(~F.col("train"), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("more")).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - zero("rest") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("score") + zero("logs") + zero("weights")).alias("score"),
    )
