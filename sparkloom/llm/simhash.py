"""Near-duplicates by SimHash fingerprints that differ in few bits, found by a Gray-order hierarchical index.

A text is lower-cased (A-Z), cut into words at ASCII white space, and each run of three words (repeats
included; a shorter text is one run) is hashed by XXH64. A bit of the fingerprint is set if it is set in
over half the hashes. No words: fingerprint zero, linked like any other. Null texts count as empty.

Upper nodes of the index are masked bit patterns. Of two fingerprints with at most `bits` differing
bits, cut into bits + 1 runs of bits, one run is equal, so each fingerprint goes under one node for each
run, and links lie under a common node. Spark groups fingerprints by node. A node with over `crowd`
members is not read as a group: its members go under bits + 1 nodes each once more, which share further
bits. Fingerprints are distinct, so a node that fixes all but r bits has at most 2^r members, and the
splitting ends; no link is lost and no group is unbounded, whatever the data are.

Below a node, members are sorted by Gray rank (neighbours in this order share long patterns), leaves
take LEAF members each, and nodes above them FAN nodes each. A node keeps the mask of bits on which all
its members agree, and their pattern. Two nodes are compared by the bits that both fix: differences
there hold for all pairs below, so a pair of nodes beyond `bits` is dropped whole; children of the
others are compared, and at the leaves fingerprints themselves. Links leave a group as a forest (one
edge a member at most), not as pairs.

Repeated rows are one document twice and share its component. Rows without an id are members as others;
a component of such rows alone has a null id. An empty table gives no rows. Other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, tidy
from .components import components

WIDTH, BITS = 64, 2
#: Members of a node that one task takes as a group; others are split further.
CROWD = 1024
LEAF, FAN = 16, 8
#: Nodes (16 bytes each) or fingerprints (24) that may be broadcast, by a count made first.
SPREAD = 50_000
#: A fingerprint of more documents than this is joined apart from the others.
COPIES = 1000
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    if not text:
        return 0
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(size + 1) - 1
    starts, n = ends - size, max(1, len(tokens) - words + 1)
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    del tokens
    digest, counts = xxhash.xxh64_intdigest, np.zeros(WIDTH, np.int64)
    for at in range(0, n, _STEP):
        spans = zip(starts[at : min(n, at + _STEP)].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.record_batch([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])
    tidy()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, print long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order: the number whose Gray code it is."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _children(parents: np.ndarray, count: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in parents, child) for all children of the nodes `parents`; `count` nodes lie below."""
    child = parents[:, None] * fan + np.arange(fan)
    at, k = np.nonzero(child < count)
    return at, child[at, k]


def near_pairs(prints: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the distinct fingerprints that differ in at most `bits` bits."""
    x = prints[np.argsort(gray_rank(prints))]
    levels, agreed, pattern, fan = [], np.full(len(x), ~np.uint64(0)), x, LEAF
    while True:  # from fingerprints to the root
        levels.append((agreed, pattern, fan))
        if len(pattern) == 1:
            break
        cuts = np.arange(0, len(pattern), fan)
        all_of, any_of = np.bitwise_and.reduceat(pattern, cuts), np.bitwise_or.reduceat(pattern, cuts)
        agreed = np.bitwise_and.reduceat(agreed, cuts) & ~(all_of ^ any_of)
        pattern, fan = all_of & agreed, FAN
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        agreed, pattern, fan = levels[depth]
        at, left = _children(a, len(pattern), fan)
        b = b[at]
        at, right = _children(b, len(pattern), fan)
        a, b = left[at], right
        keep = a <= b if depth else a < b
        a, b = a[keep], b[keep]
        certain = np.bitwise_count((pattern[a] ^ pattern[b]) & agreed[a] & agreed[b])
        a, b = a[certain <= bits], b[certain <= bits]
    return (x[a], x[b]) if len(levels) > 1 else (x[:0], x[:0])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for each member of the pairs; the root is the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _linked(bits: int):
    def run(batches):
        for batch in batches:
            for members in batch.column("members"):
                pairs = near_pairs(members.values.to_numpy(zero_copy_only=False).view(np.uint64), bits)
                nodes, roots = forest(*(p.view(np.int64) for p in pairs))
                yield pa.record_batch([pa.array(nodes), pa.array(roots)], ["a", "b"])

    return run


def runs_of(open_bits: int, bits: int) -> list[int]:
    """The bits of `open_bits` that vary, cut into bits + 1 runs; for each the mask of all other settled
    bits and the run."""
    varying = [k for k in range(WIDTH) if open_bits >> k & 1]
    settled = ~open_bits & (1 << WIDTH) - 1
    return [settled | sum(1 << k for k in run.tolist()) for run in np.array_split(varying, bits + 1)]


def _signed(x: int) -> int:
    return x - (1 << WIDTH) if x >> (WIDTH - 1) else x


def _split(bits: int):
    def run(batches):
        for b in batches:
            cells = [[_signed(m) for m in runs_of((all_of ^ any_of) % (1 << WIDTH), bits)] for all_of, any_of in zip(b.column("all_of").to_pylist(), b.column("any_of").to_pylist())]
            yield pa.record_batch([b.column("mask"), b.column("pattern"), pa.array(cells, pa.list_(pa.int64()))], ["mask", "pattern", "below"])

    return run


def _under(rows: DataFrame) -> DataFrame:
    """Each row (print, below) under the nodes whose masks are in `below`."""
    return rows.select("print", F.explode("below").alias("mask")).select("print", "mask", F.col("print").bitwiseAND(F.col("mask")).alias("pattern"))


def links(prints: DataFrame, bits: int = BITS, crowd: int = CROWD) -> list[DataFrame]:
    """Tables (a, b) of edges whose components are those of all pairs of fingerprints (distinct longs in
    column `print`) that differ in at most `bits` bits. Each is a stored table. crowd: 2 ** bits at
    least, so that in a node beyond it more than `bits` bits vary."""
    if crowd < 1 << bits:
        raise ValueError("crowd is less than 2 ** bits")
    node = ["mask", "pattern"]
    rows = _under(prints.select("print", F.array(*[F.lit(_signed(m)) for m in runs_of((1 << WIDTH) - 1, bits)]).alias("below")))
    found = []
    while True:
        sized = rows.groupBy(*node).agg(F.count("*").alias("members"), F.bit_and("print").alias("all_of"), F.bit_or("print").alias("any_of"))
        crowded = stored(sized.where(F.col("members") > crowd).mapInArrow(_split(bits), "mask long, pattern long, below array<long>"), "crowded")
        n = crowded.count()
        few = F.broadcast(crowded) if n <= SPREAD else crowded
        small = rows.join(few.select(*node), node, "left_anti") if n else rows
        groups = small.groupBy(*node).agg(F.collect_list("print").alias("members")).where(F.size("members") > 1)
        found.append(stored(groups.select("members").mapInArrow(_linked(bits), "a long, b long"), "simhash-links"))
        if not n:
            return found
        rows = _under(rows.join(few, node).select("print", "below"))


def link(docs: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """docs has doc_id and text. Returns doc_id, fingerprint (16 hexadecimal digits), component_id (the
    least doc_id that links reach)."""
    named = stored(fingerprints(docs), "prints")
    prints = stored(named.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "prints")
    # A fingerprint is named by its least document, so the least name of a component is its result.
    name = F.struct(F.col("least").isNull().alias("nameless"), "least", "print")
    found = links(prints.select("print"), bits, crowd)
    edges = functools.reduce(DataFrame.unionByName, found)
    for end in ("a", "b"):
        edges = edges.join(prints.select(F.col("print").alias(end), name.alias(f"{end}_name")), end)
    groups = components(edges.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")))
    drop_stored(*found)
    roots = groups.select(F.col("node.print").alias("print"), F.col("root.least").alias("root"))
    names = stored(prints.join(roots, "print", "left").select("print", "rows", F.coalesce("root", "least").alias("component_id")), "simhash-names")
    drop_stored(groups, prints)
    copied = names.where(F.col("rows") > COPIES).drop("rows")
    if 0 < copied.count() <= SPREAD:
        many = F.broadcast(copied)
        out = named.join(many, "print").unionByName(named.join(many, "print", "left_anti").join(names.drop("rows"), "print"))
    else:
        out = named.join(names.drop("rows"), "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
