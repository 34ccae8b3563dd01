"""Language identification by word-first backoff.

A word that training has seen is scored by its per-language log frequency. For any other word the
longest character n-grams (four down to one, with word edges) of which at least one is known stand
in, as the mean of their log frequencies. Sums over a whole text go through a softmax. Words are runs
of letters and marks; words and n-grams are told apart by 64-bit hashes, so that a text is read with
array operations only.

The classifier is fitted on a sample of about `sample_rows` labelled rows, chosen by a hash of the
key and the text. Its table is sparse: a language takes room only where it has an n-gram. All words and n-grams of
the sample stay, as long as these are at most `features`; beyond, the rarest go, those of one count
together. Prediction reads whole texts of all rows, long ones some characters at a time.

Text that is null or has no letter: language `und`, score 0. No training rows: the same for all.
Ties between languages go to the name that sorts first. Repeated rows count as often as they occur.
A null key counts as a key. Other columns stay as they are; `to` replaces a column of its name.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, least_reaching, stored, tidy
from .jaccard_join import mixed, names, powers

SAMPLE_ROWS = 30_000
FEATURES = 1_000_000
LONGEST = 4
UNDETERMINED = "und"
STEP_CHARS = 1 << 19


@cache
def kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a mark, 0 neither."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.array([1 if x == "L" else 2 if x == "M" else 0 for x in first], np.uint8)


def chunks(texts: list[str | None], most: int | None = None):
    """Row numbers and lower-case texts, about `most` characters at a time. Longer texts are cut
    between words; only a word of over `most` letters is cut itself."""
    most = most or STEP_CHARS
    rows, parts, held = [], [], 0
    for k, t in enumerate(texts):
        t, at = (t or "").lower(), 0
        while at < len(t):
            end = min(len(t), at + most)
            if end < len(t):
                cut = end
                while cut > at and kinds()[ord(t[cut])]:
                    cut -= 1
                end = cut if cut > at else end
            rows.append(k)
            parts.append(t[at:end])
            held += end - at
            at = end
            if held >= most:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
    if rows:
        yield np.array(rows), parts


class Words:
    """The words of some texts, and hashes of any ranges of their characters."""

    def __init__(self, texts: list[str]):
        self.flat = flat = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[flat]
        inside = kind > 0
        power, self.inverse = powers(len(flat) + 1)
        value = mixed(np.where(inside, flat, 0).astype(np.uint64), 31)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(flat)])])
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        sizes = np.array([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(np.cumsum(sizes), self.start - 1, "right")
        letters = np.concatenate([[0], np.cumsum(kind == 1)])
        self.lettered = letters[self.end] > letters[self.start]

    def hashes(self, start, end, n):
        if not n:
            return names(self.flat.view(np.uint8), 4 * start, 4 * end, 31)
        return mixed((self.total[end] - self.total[start]) * self.inverse[start], n)


def windows(start: np.ndarray, end: np.ndarray, n: int):
    """Of each word, the n-grams: which word, and where. All but single letters reach the edges."""
    a, z = (start, end) if n == 1 else (start - 1, end + 1)
    many = np.maximum(z - a - n + 1, 0)
    own = np.repeat(np.arange(len(a)), many)
    return own, a[own] + np.arange(len(own)) - (np.cumsum(many) - many)[own]


def summed(lang: np.ndarray, h: np.ndarray, n: np.ndarray):
    """Sums of n for equal lang and h."""
    order = np.lexsort((h, lang))
    lang, h = lang[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (h[1:] != h[:-1])])[: len(h)])
    return lang[first], h[first], np.add.reduceat(n[order], first) if len(first) else n, order[first]


def counts(batches):
    """(lang, n, gram, count) of some texts at a time; n = 0 for whole words."""
    for b in batches:
        named = b.column("lang").dictionary_encode()
        own = named.indices.to_numpy(zero_copy_only=False)
        for rows, parts in chunks(b.column("text").to_pylist()):
            w = Words(parts)
            lang, h, n, first = summed(own[rows[w.doc]], w.hashes(w.start, w.end, 0), np.ones(len(w.start), np.int64))
            levels = [(0, lang, h, n)]
            for k in range(1, LONGEST + 1):
                word, at = windows(w.start[first], w.end[first], k)
                levels.append((k, *summed(lang[word], w.hashes(at, at + k, k), n[word])[:3]))
            yield pa.record_batch(
                [
                    named.dictionary.take(pa.array(np.concatenate([x[1] for x in levels]))),
                    pa.array(np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in levels])),
                    pa.array(np.concatenate([x[2] for x in levels]).view(np.int64)),
                    pa.array(np.concatenate([x[3] for x in levels])),
                ],
                ["lang", "n", "gram", "count"],
            )
    tidy()


class Model:
    """Log frequencies: of unseen n-grams for each level and language, and what the seen ones add."""

    def __init__(self, rows: pa.Table, totals: dict[tuple[str, int], tuple[int, int]]):
        """totals: (lang, n) -> all occurrences and distinct grams in the sample."""
        self.langs = sorted({x for x, _ in totals})
        col = {x: k for k, x in enumerate(self.langs)}
        at = lambda n, k: np.array([totals.get((x, n), (0, 0))[k] for x in self.langs], float)
        self.unseen = np.array([np.log(0.5 / (at(n, 0) + 0.5 * max(1.0, *at(n, 1)))) for n in range(LONGEST + 1)]) if self.langs else np.zeros((LONGEST + 1, 0))
        named = rows["lang"].combine_chunks().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
        lang = np.array([col[x] for x in named.dictionary.to_pylist()], np.int32)[named.indices.to_numpy(zero_copy_only=False)] if len(rows) else np.zeros(0, np.int32)
        level, gram, count = (rows[c].to_numpy() for c in ("n", "gram", "count"))
        self.levels = []
        for n in range(LONGEST + 1):
            k = np.flatnonzero(level == n)
            k = k[np.lexsort((lang[k], gram[k].view(np.uint64)))]
            names, begin = np.unique(gram[k].view(np.uint64), return_index=True)
            self.levels.append((names, np.append(begin, len(k)), lang[k], np.log1p(2.0 * count[k]).astype(np.float32)))

    def entries(self, n: int, h: np.ndarray) -> np.ndarray:
        """Place of each hash in level n, or -1."""
        names = self.levels[n][0]
        if not len(names):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(names, h), len(names) - 1)
        return np.where(names[k] == h, k, -1)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers (-1: undetermined) and scores."""
        size, sums = len(self.langs), np.zeros(len(texts) * len(self.langs))
        weight, lettered = np.zeros(len(texts) * (LONGEST + 1)), np.zeros(len(texts), bool)

        def add(n, doc, entry, by):
            _, begin, lang, more = self.levels[n]
            many = begin[entry + 1] - begin[entry]
            at = np.repeat(begin[entry] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            sums[:] += np.bincount(np.repeat(doc, many) * size + lang[at], np.repeat(by, many) * more[at], len(sums))
            weight[:] += np.bincount(doc * (LONGEST + 1) + n, by, len(weight))

        for rows, parts in chunks(texts) if size else ():
            w = Words(parts)
            start, end, doc = w.start, w.end, rows[w.doc]
            lettered[doc[w.lettered]] = True
            entry = self.entries(0, w.hashes(start, end, 0))
            seen = entry >= 0
            add(0, doc[seen], entry[seen], np.ones(int(seen.sum())))
            start, end, doc = start[~seen], end[~seen], doc[~seen]
            for n in range(LONGEST, 0, -1):
                word, at = windows(start, end, n)
                entry = self.entries(n, w.hashes(at, at + n, n))
                word, entry = word[entry >= 0], entry[entry >= 0]
                many = np.bincount(word, minlength=len(start))
                add(n, doc[word], entry, 1 / many[word])
                start, end, doc = start[many == 0], end[many == 0], doc[many == 0]
        if not size:
            return np.full(len(texts), -1), np.zeros(len(texts))
        z = sums.reshape(-1, size) + weight.reshape(-1, LONGEST + 1) @ self.unseen
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return np.where(lettered, best, -1), np.where(lettered, p[np.arange(len(p)), best], 0.0)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits on about `sample_rows` of the rows that have a text and a language, chosen by a hash of key
    and text: rows without a key are sampled as others are. Rows that are equal in both are all in or out."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = rows.count()
    if n > sample_rows:
        grain = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(grain)) < int(grain * sample_rows / n))
    c = stored(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(counts, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "grams")
    totals = c.groupBy("lang", "n").agg(F.sum("count").alias("all"), F.count("*").alias("kinds")).collect()
    model = Model(c.where(F.col("count") >= least_reaching(c, "count", features)).toArrow(), {(r["lang"], r["n"]): (r["all"], r["kinds"]) for r in totals})
    drop_stored(c)
    return model


def predict(df: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """Adds `to`, a struct of lang and score. Reads nothing but the text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def said(col: pa.Array) -> pa.Array:
        m = sent.value
        names, step = np.array([*m.langs, UNDETERMINED], object), 256
        got = [m.predict(col.slice(k, step).to_pylist()) for k in range(0, len(col), step)]
        lang, score = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, int) for k in (0, 1))
        tidy()
        return pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return df.withColumn(to, said(F.col(text)))


def accepted(language: Column, least: float = 0.5) -> Column:
    """A text has a language if one is found at all and it is likelier than all others together."""
    return (language["lang"] != UNDETERMINED) & (language["score"] > least)
