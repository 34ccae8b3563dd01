"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles, as 64-bit hashes; equal sets form a class
with a 128-bit signature. All shingles have one global order, rare ones first. Two sets of Jaccard
0.8 or more that both show their first n - ceil(0.8 n) + l shingles have at least l of these in
common, for any l. Each document takes its own l: the one with the least estimated cost of reading
its prefix and of verifying the candidates that l matches let through; a pair needs the lesser l of
the two. Long texts and texts with common shingles thus need several matches. Frequencies come from
a count of all rows in a table of fixed size; they set the order and l, and have no effect on results.

Prefix shingles are dealt out once, many of them in eight passes by their hashes, so that disks hold an
eighth of them at a time. Texts are dealt out only if they may be asked for (`common.marks`). Where a
shingle has few classes its pairs of fitting sizes are counted. Where it has many, neighbours by size
are chained instead, so that rows stay linear, and a run is read row by row. The candidate graph falls
into components, whose sets meet in tasks of bounded size and are verified exactly (`link_sets`). A
component too large for one task is first held against one of its sets, a block in each task; only sets
that this does not link meet all blocks.

Results: null, empty and blank texts have an empty set and are linked with nothing. Rows with equal
sets are one class, repeated rows included. Keys may repeat or be missing: rows are told apart by key
and text, and a missing key counts as the largest, so a component has a null id only if all its keys
are null. Ties do not occur; no rows give no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICED, dealt, drop_stored, fresh, marked, marks, sliced, sliced_sum, stored, tidy
from .components import components

SHINGLE = 5
SKETCH_BITS = 20  #: of the table that shingles are counted in
RUN = 64  #: classes of one shingle up to which all pairs are counted
MOST_L = 16
BLOCK_SHINGLES = 3_000_000  #: of the sets that one verifying task holds at a time, per block
STEP_BYTES = 1 << 20
POSTS_A_TASK = 1_000_000
PASSES = 8  #: in which prefix shingles are dealt out, by their hashes
ONE_PASS = 4_000_000  #: prefix shingles up to which one pass does

LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_random = np.random.default_rng(20240607)
BYTE_VALUE = _random.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalizer that spreads all bits."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


LONG = 256  #: bytes of a word from which on it is hashed by itself


def names(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name for each range of bytes. Eight bytes at a time go through a mixer that depends on
    all before, so it is no polynomial: of ranges of one length, those of up to eight bytes have
    different names, and no pattern makes longer ones alike. Long ones are hashed by BLAKE2."""
    held = np.concatenate([flat, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(flat) + 1,), "<u8", held, strides=(1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64) * BASE, salt)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        mask = ~np.uint64(0) >> (np.uint64(64) - 8 * left.astype(np.uint64))
        h[live] = mixed(h[live] ^ (lanes[starts[live] + at] & mask), 7)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        raw = hashlib.blake2b(held[starts[k] : ends[k]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
        h[k] = int.from_bytes(raw, "little")
    return h


def shingles(raws: list[bytes | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct shingles of each text, sorted by both."""
    lines = [b" ".join((r or b"").translate(LOWER).split()) for r in raws]
    flat = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    blank = np.flatnonzero(flat == 32)
    n_words = np.array([x.count(b" ") + 1 if x else 0 for x in lines])
    # An empty line leaves a blank of its own; its "word" is empty and gets no shingle.
    slots = np.maximum(n_words, 1)
    ends = blank  # the k-th slot ends at the k-th blank
    starts = np.concatenate([[0], blank[:-1] + 1])
    first = np.concatenate([[0], np.cumsum(slots)[:-1]])
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    rows = np.repeat(np.arange(len(raws)), n_sh)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + first[rows]
    word, many = names(flat, starts, ends, 11), np.minimum(width, n_words[rows])
    h = many.astype(np.uint64)
    for k in range(width):  # a shingle is the sequence of its words' names
        more = k < many if k else slice(None)
        h[more] = mixed(h[more] ^ word[at[more] + k], k + 1)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])])
        rows, h = rows[new], h[new]
    return rows, h


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def signatures(h: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    a, b = sums(mixed(h, 1), sizes), sums(mixed(h, 2), sizes)
    raw = np.stack([a, b], 1).astype(">u8").tobytes()
    return [raw[16 * k : 16 * k + 16] if n else None for k, n in enumerate(sizes)]


def pieces(batches, columns: list[str]):
    """Rows some texts at a time, by bytes. The last column has the texts."""
    for b in batches:
        cols = [b.column(c) for c in columns]
        ends = np.cumsum(pc.fill_null(pc.binary_length(cols[-1]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, begin = 0, 0
        while start < b.num_rows:
            stop = min(b.num_rows, int(np.searchsorted(ends, begin + STEP_BYTES)) + 1)
            yield [c.slice(start, stop - start) for c in cols[:-1]], cols[-1].slice(start, stop - start).cast(pa.binary()).to_pylist()
            start, begin = stop, int(ends[stop - 1])
    tidy()


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-4 * n // 5)


def choose_l(n: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The l of least cost: prefix rows, and n operations for each candidate, of which a summed
    prefix frequency of f leaves about f / l**2."""
    l = np.arange(1, MOST_L + 1)
    f = (frequency + 0.02 * (n - needed(n) + 1))[:, None]
    cost = 4 * l[None] + n[:, None] * f / l[None] ** 2
    return np.maximum(1, np.minimum(l[cost.argmin(1)], needed(n)))


#: The columns of prefix shingles, one for each pass.
SHOWN = [f"shown{k}" for k in range(PASSES)]


def features(docs: DataFrame, frequent) -> DataFrame:
    """docs: key, text. Returns key, n, sig, l and the prefix, as a column for each pass; these are null
    for sets that the task has seen."""

    def run(batches):
        often = frequent.value
        seen: set[bytes] = set()
        for (keys,), raws in pieces(batches, ["key", "text"]):
            rows, h = shingles(raws)
            n = np.bincount(rows, minlength=len(raws))
            sigs = signatures(h, n)
            f = often[place(h)]
            order = np.argsort((rows << 24) | np.minimum(f, (1 << 24) - 1), kind="stable")
            h, f = h[order], f[order]
            begin = np.cumsum(n) - n
            one = n - needed(n) + 1
            at = np.arange(len(h)) - begin[rows]
            l = choose_l(n, sums(np.where(at < one[rows], f, 0), n))
            size = np.where(n > 0, n - needed(n) + l, 0)
            prefixes: list[list] = [[] for _ in SHOWN]
            for k, s in enumerate(sigs):
                new = s is not None and s not in seen
                shown = h[begin[k] : begin[k] + size[k]]
                turn = shown % np.uint64(PASSES)
                for p, column in enumerate(prefixes):
                    column.append(shown[turn == p].view(np.int64) if new else None)
                if new:
                    seen.add(s)
            yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(l, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in prefixes)], ["key", "n", "sig", "l", *SHOWN])
            if len(seen) > 100_000:
                seen = set()

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(run, f"key {kind}, n long, sig binary, l int, " + ", ".join(f"{c} array<long>" for c in SHOWN))


def place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """How often shingles of each place of the table occur in all rows, less what a place has on
    average: rare shingles count as zero, however many there are."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, raws in pieces(batches, ["text"]):
            total += np.bincount(place(shingles(raws)[1]), minlength=len(total))
        yield sliced(total)

    total = sliced_sum(docs.select("text").mapInArrow(run, SLICED), 1 << SKETCH_BITS)
    return np.clip(total - int(np.ceil(total.mean())), 0, (1 << 31) - 1).astype(np.int32)


EDGES = "a binary, b binary, least int, kind int"


def scan(batches):
    """Sorted prefix rows to candidate pairs (kind 0), chain edges of long runs (1) and, for each
    class in a long run, a row that says so (2). Of a run, at most RUN classes are held."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    token, own, long = None, [], False  # of the run that is open; own: sig, n, l of its classes

    def edge(a, b, least, kind):
        for col, x in zip(out, (a, b, least, kind)):
            col.append(x)

    def chain(last, row):
        if last is not None and 4 * row[1] <= 5 * last[1]:
            edge(last[0], row[0], 0, 1)
        edge(row[0], row[0], 0, 2)

    def close():
        for i, (x, n, l) in enumerate(() if long else own):
            for y, m, k in own[i + 1 :]:
                if 4 * m > 5 * n:
                    break
                edge(min(x, y), max(x, y), min(l, k), 0)

    for b in batches:
        tok = b.column("token").to_numpy()
        same = tok[1:] == tok[:-1]
        edges = [len(tok) == 0 or tok[0] == token], [True]  # the last row's run stays open
        keep = np.flatnonzero(np.concatenate([edges[0], same]) | np.concatenate([same, edges[1]])[: len(tok)]) if len(tok) else []
        part = b.take(pa.array(keep, pa.int64()))
        for t, *row in zip(*(part.column(c).to_pylist() for c in ("token", "sig", "n", "l"))):
            if t != token:
                close()
                token, own, long = t, [], False
            elif row[0] == own[-1][0]:
                continue
            if long:
                chain(own[-1], row)
                own = [row]
                continue
            own.append(row)
            if len(own) > RUN:
                for last, x in zip([None, *own], own):
                    chain(last, x)
                long, own = True, [row]
        if len(out[0]) > 10_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["a", "b", "least", "kind"])
            out = ([], [], [], [])
    close()
    yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["a", "b", "least", "kind"])


def candidates(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges a, b of the candidate graph between signatures, and the stored tables they come from."""
    shown = rows.where(f"{SHOWN[0]} is not null")
    many = shown.agg(F.coalesce(F.sum(sum(map(F.size, SHOWN))), F.lit(0))).first()[0]
    posts = lambda *columns: shown.select(F.explode(F.concat(*columns)).alias("token"), "sig", F.col("n").cast("int").alias("n"), "l")
    turns = [SHOWN] if many <= ONE_PASS else [[c] for c in SHOWN]
    tables = [stored(dealt(posts(*t), -(-many // len(turns)), POSTS_A_TASK, "token").sortWithinPartitions("token", "n", "sig").mapInArrow(scan, EDGES), "edges") for t in turns]
    edges = reduce(DataFrame.unionAll, tables)
    pairs = edges.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("met"), F.first("least").alias("least"))
    hot = edges.where("kind = 2").groupBy(F.col("a").alias("h")).agg(F.count("*").alias("hot"))
    # Shingles of long runs are not counted, so a pair may have as many more matches as both have of them.
    enough = pairs.where("met >= least").select("a", "b")
    some = pairs.where("met < least").join(hot.withColumnsRenamed({"h": "a", "hot": "ha"}), "a").join(hot.withColumnsRenamed({"h": "b", "hot": "hb"}), "b").where(F.col("met") + F.least("ha", "hb") >= F.col("least")).select("a", "b")
    return enough.unionAll(some).unionAll(edges.where("kind = 1").select("a", "b")), tables


class Groups:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def link_sets(sigs: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links that connect just those sets that links among all of them connect.

    Linked sets share one of their first n - ceil(0.8 n) + 1 shingles in the order of rarity here, so
    only sets that meet in an index of these are compared. First, leaders: a set that no leader links
    yet becomes one, and is compared with all that it meets. Then the rest: within each run of the
    index, sets outside its largest group are compared with those of other groups. Copies of one text
    thus cost one comparison each, and unrelated sets none."""
    size = np.array([len(s) for s in sets])
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code)
    ends = np.cumsum(size)
    first = size - needed(size) + 1
    prefixes = []
    for e, n, k in zip(ends.tolist(), size.tolist(), first.tolist()):
        own = code[e - n : e]
        prefixes.append(own[np.lexsort((own, often[own]))[:k]])
    token, owner = np.concatenate(prefixes), np.repeat(np.arange(len(sets)), first)
    order = np.lexsort((owner, size[owner], token))
    token, owner = token[order], owner[order]
    begin = np.searchsorted(token, np.arange(len(names) + 1))
    groups, links = Groups(len(sets)), []

    def compare(x: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are linked with x."""
        others = others[(4 * size[others] <= 5 * size[x]) & (4 * size[x] <= 5 * size[others])]
        if not len(others):
            return others
        flat = np.concatenate([code[ends[y] - size[y] : ends[y]] for y in others])
        own = code[ends[x] - size[x] : ends[x]]  # ascending, as the sets are
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = sums((own[at] == flat).astype(np.int64), size[others])
        return others[100 * both >= 80 * (size[others] + size[x] - both)]

    def link(x: int, others: np.ndarray) -> None:
        for y in compare(x, others).tolist():
            if groups.join(x, y):
                links.append((sigs[x], sigs[y]))

    led = np.zeros(len(sets), bool)
    for x in np.argsort(size, kind="stable").tolist():
        if led[x]:
            continue
        met = np.unique(np.concatenate([owner[begin[t] : begin[t + 1]] for t in prefixes[x]]))
        met = met[met != x]
        led[x] = True
        near = compare(x, met)
        led[near] = True
        for y in near.tolist():
            if groups.join(x, y):
                links.append((sigs[x], sigs[y]))
    tried: set[tuple[int, int]] = set()
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
        run = owner[s:e]
        group = np.array([groups.root(x) for x in run.tolist()])
        if e - s < 2 or (group == group[0]).all():
            continue
        values, where, many = np.unique(group, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(where != many.argmax()).tolist():
            x = int(run[k])
            others = np.array([y for y in run.tolist() if y != x and groups.root(y) != groups.root(x) and (min(x, y), max(x, y)) not in tried], np.int64)
            tried.update((min(x, y), max(x, y)) for y in others.tolist())
            link(x, others)
    return links


def packed(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])


def verify(batches):
    """Links within each root and pair of blocks i, j; rows come sorted by these and by signature."""
    name, sigs, sets = None, [], []

    for b in batches:
        for root, i, j, sig, raw in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "sig", "set"))):
            if (root, i, j) != name:
                if len(sigs) > 1:
                    yield packed(link_sets(sigs, sets))
                name, sigs, sets = (root, i, j), [], []
            if not sigs or sig != sigs[-1]:
                sigs.append(sig)
                sets.append(np.frombuffer(raw, np.uint64))
    if len(sigs) > 1:
        yield packed(link_sets(sigs, sets))


def star(batches):
    """Links of each root's pivot, which comes first in each of its blocks."""
    name, pivot, own = None, b"", np.zeros(0, np.uint64)
    for b in batches:
        out = []
        for root, i, first, sig, raw in zip(*(b.column(c).to_pylist() for c in ("root", "i", "first", "sig", "set"))):
            x = np.frombuffer(raw, np.uint64)
            if first:
                name, pivot, own = (root, i), sig, x
            elif name == (root, i) and sig != pivot:
                both = len(np.intersect1d(own, x, True))
                if 100 * both >= 80 * (len(own) + len(x) - both):
                    out.append((pivot, sig))
        yield packed(out)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: key, sig, root, blocks. Adds the set itself, as packed 64-bit hashes."""

    def run(batches):
        for (sig, root, blocks), raws in pieces(batches, ["sig", "root", "blocks", "text"]):
            rows, h = shingles(raws)
            n = np.bincount(rows, minlength=len(raws))
            ends = np.cumsum(n)
            sets = [h[e - k : e].tobytes() for e, k in zip(ends, n)]
            yield pa.record_batch([sig, root, blocks, pa.array(sets, pa.binary())], ["sig", "root", "blocks", "set"])

    # Few of all texts are wanted, and only these are dealt out.
    likely = marked(docs, "key", marks(wanted, "key"), "likely").where("likely")
    joined = likely.join(wanted.hint("shuffle_hash"), "key").select("sig", "root", "blocks", "text")
    return joined.mapInArrow(run, "sig binary, root binary, blocks int, set binary")


def block_of(blocks) -> Column:
    return F.pmod(F.xxhash64("sig"), blocks).cast("int")


def exact_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members: root, sig, key (of a row that has the set), n. Returns links a, b."""
    sizes = members.groupBy("root").agg(F.sum("n").alias("total"), F.avg("n").alias("mean"))
    sizes = stored(sizes.select("root", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"), "mean", "total"), "sizes")
    total, most = sizes.agg(F.coalesce(F.sum("total"), F.lit(0)), F.max("blocks")).first()
    deal = lambda df, times, *by: dealt(df, total * times, BLOCK_SHINGLES, *by).sortWithinPartitions(*by, "sig")
    wanted = members.join(sizes.select("root", "blocks"), "root").select("key", "sig", "root", "blocks")
    sets = sets_of(docs, wanted)
    pair = lambda df, i, j: df.select("root", i.alias("i"), j.alias("j"), "sig", "set")
    if (most or 1) == 1:
        return deal(pair(sets, F.lit(0), F.lit(0)), 1, "root", "i", "j").mapInArrow(verify, LINKS)
    sets = stored(sets.withColumn("i", block_of(F.col("blocks"))), "components")
    links = deal(pair(sets.where("blocks = 1"), F.lit(0), F.lit(0)), 1, "root", "i", "j").mapInArrow(verify, LINKS)
    large = sets.where("blocks > 1")
    # A set of about the mean size, in every block of its root.
    pivots = members.join(sizes.where("blocks > 1"), "root").groupBy("root", "blocks").agg(F.min_by("sig", F.struct(F.abs(F.col("n") - F.col("mean")), "sig")).alias("sig"))
    ones = large.drop("blocks", "i").join(pivots, ["root", "sig"]).dropDuplicates(["root", "sig"])
    ones = ones.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(True).alias("first"), "sig", "set")
    both = ones.unionByName(large.select("root", "i", F.lit(False).alias("first"), "sig", "set"))
    near = stored(dealt(both, total, BLOCK_SHINGLES, "root", "i").sortWithinPartitions("root", "i", F.desc("first")).mapInArrow(star, LINKS), "star")
    # What the pivot does not link meets all blocks.
    done = near.select(F.col("b").alias("sig")).unionAll(near.select(F.col("a").alias("sig"))).unionAll(pivots.select("sig")).distinct()
    rest = stored(large.join(done, "sig", "left_anti"), "rest")
    pieces_ = rest.groupBy("root").agg(F.ceil(F.sum(F.octet_length("set")) / (8 * BLOCK_SHINGLES)).cast("int").alias("parts"))
    times = 1 + (pieces_.agg(F.max("parts")).first()[0] or 0)
    every = large.join(pieces_, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one = rest.join(pieces_, "root").withColumn("part", block_of(F.col("parts"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = pair(every, F.col("part"), F.col("i")).unionAll(pair(one, F.col("part"), F.col("j")))
    return links.unionAll(near).unionAll(deal(met, times, "root", "i", "j").mapInArrow(verify, LINKS))


LINKS = "a binary, b binary"


def linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each row: `key`, a struct that tells rows apart by key and text, n, and `component`, the
    least such struct that links reach."""
    docs = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("key"), F.col(text).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequencies(docs))
    rows = stored(features(docs, frequent), "sets")
    frequent.unpersist()
    classes = stored(rows.where("sig is not null").groupBy("sig").agg(F.min("key").alias("rep"), F.max("n").alias("n")), "classes")
    edges, tables = candidates(rows)
    graph = components(edges)
    shown, rows = rows, stored(rows.select("key", "n", "sig"), "names")
    members = stored(graph.withColumnRenamed("node", "sig").join(classes, "sig").withColumnRenamed("rep", "key"), "near")
    drop_stored(shown, graph, *tables)
    found = components(exact_links(docs, members)).withColumnRenamed("node", "sig").join(classes, "sig")
    lowest = found.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = classes.join(found.join(lowest, "root").select("sig", "component"), "sig", "left").select("sig", F.least("rep", F.coalesce("component", "rep")).alias("component"))
    return rows.select("key", "n", "sig").join(of_class, "sig", "left").select("key", "n", F.coalesce("component", "key").alias("component"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, n_shingles and component_id (the smallest key reachable by links, or the row's
    own) for each row of docs."""
    return linked(docs, key, text).select(F.col("key.key").alias(key), F.col("n").alias("n_shingles"), F.col("component.key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: one with its least key. Rows are told apart by key and text
    together, so missing and repeated keys merge no unrelated texts; of rows alike in both any one
    stays. Rows without words are all kept."""
    name, found, times, stays, doubt = (fresh(docs, c) for c in ("_row", "_found", "_times", "_stays", "_doubt"))
    words = F.coalesce(F.col(text).rlike(r"[^ \t\n\x0b\f\r]"), F.lit(False))
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    rows = docs.where(words)
    names = linked(rows, key, text).groupBy(F.col("key").alias(found)).agg(F.count("*").alias(times), F.bool_and(F.col("key") == F.col("component")).alias(stays))
    # Most rows stay for certain, and where they are; only those that may go, or are alike, are dealt out.
    doubtful = stored(names.where(~F.col(stays) | (F.col(times) > 1)), "doubtful")
    rows = marked(rows.withColumn(name, own), name, marks(doubtful, found), doubt)
    met = rows.where(F.col(doubt)).join(doubtful.hint("shuffle_hash"), F.col(name) == F.col(found), "left")
    out = rows.where(~F.col(doubt)).select(docs.columns).unionAll(met.where(F.col(found).isNull()).select(docs.columns))
    alike = doubtful.where(stays)
    if not alike.isEmpty():
        out = out.unionAll(met.where(stays).dropDuplicates([name]).select(docs.columns))
    return out.unionAll(docs.where(~words))
