"""Centroid clustering, SimHash links and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkloom.llm import centroids, components, lexical, queries, simhash

CLASH = "'clash' AS {}"


# Centroids


def lloyd(vectors, k=8, rounds=10):
    """vectors: (id, list of whole numbers). Plain rounds over all centroids."""
    order = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"3:{v[0]}".encode()).hexdigest(), v[1]))
    c = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in vectors]

    for _ in range(rounds):
        mine = assign()
        for j in range(len(c)):
            own = [x for (_, x), (_, n) in zip(vectors, mine) if n == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return c, assign()


def digest(c):
    return hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()


def expected(rows):
    def good(v):
        return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if good(v)]
    c, mine = lloyd(kept)
    each = Counter()
    for d, j in mine:
        each[j] += d
    total = sum(each.values())
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, j, fits(d), fits(each[j]), fits(total), digest(c[j])) for (i, _), (d, j) in zip(kept, mine)), key=repr)


def vectors(seed, n, spread):
    rng = random.Random(seed)
    rows = [(k, [round(rng.gauss(0, spread), 3) for _ in range(64)]) for k in range(n)]
    return rows + [rows[2], rows[2], (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (None, [0.25] * 64), (905, [-0.0] * 64)]


@pytest.mark.parametrize("rows", [vectors(1, 60, 1.0), vectors(2, 40, 100.0), vectors(3, 3, 1.0), vectors(4, 30, 1.0) + [(950, [1e9] + [0.0] * 63), (951, [3e38] * 64)], [(k, [float(k % 2)] * 64) for k in range(30)]])
def test_centroids_as_plain_rounds(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS cluster", "'y' AS id", "1 AS vector", "2 AS distance").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_centroids(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_centroids_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_centroids(spark, str(tmp_path)).collect() == []


def test_annulus_keeps_the_border():
    c = [[3, 4], [0, 5], [5, 0], [6, 0], [0, -5]]
    index = centroids.Annulus(c)
    x = np.array([[a, b] for a in range(-7, 8) for b in range(-7, 8)], np.int64)
    number, best = index.nearest(x)
    want = [min(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, j) for j, q in enumerate(c)) for p in x.tolist()]
    assert list(zip(best.tolist(), number.tolist())) == want
    assert list(zip(*(v.tolist() for v in index.nearest(x.astype(object))))) == [(j, d) for d, j in want]


# SimHash


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Least id of each row's component, by comparing all rows."""
    root = list(range(len(prints)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least.setdefault(find(k), []).append(i)
    smallest = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    return [smallest[find(k)] for k in range(len(prints))]


def texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Über", "naïve", "É"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    base = prose(400)
    out = [None, "", " \t\n", "One", "one two", "ONE  two", "one two", "a b c", "x " * 70_000, " ".join(base), " ".join(base).upper()]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append("\n".join(w))
    return out + [" ".join(prose(rng.randrange(1, 60))) for _ in range(40)]


def test_simhash_links(spark, tmp_path):
    rows = list(enumerate(texts(), 10))
    rows += [rows[9], rows[9], (None, "one two"), (None, "nobody else says this"), (3, rows[20][1])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS print", "2 AS mask", "'c' AS component_id").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, classes(prints))), key=repr)
    assert sorted((tuple(r) for r in queries.op12_simhash(spark, str(tmp_path)).collect()), key=repr) == want
    assert len({c for *_, c in want}) < len(want) - 5


def test_simhash_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_simhash(spark, str(tmp_path)).collect() == []


def test_near_pairs_of_all_kinds():
    rng = random.Random(9)
    for size, width in [(1, 64), (2, 64), (40, 6), (300, 10), (900, 12), (500, 64)]:
        x = {rng.getrandbits(width) for _ in range(size)}
        x |= {v ^ 1 << rng.randrange(64) for v in list(x)[::3]} | {v ^ 1 << 63 ^ 1 for v in list(x)[::5]}
        a, b = simhash.near_pairs(np.array(list(x), np.uint64))
        got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        every = list(x)
        assert got == {frozenset((p, q)) for k, p in enumerate(every) for q in every[:k] if (p ^ q).bit_count() <= 2}
        assert len(got) == len(a)


def test_gray_rank_orders_codes():
    k = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(k ^ (k >> np.uint64(1))) == k).all()


@pytest.mark.parametrize("crowd", [20, 60])
def test_crowded_nodes_are_split(spark, crowd):
    rng = random.Random(crowd)
    x = {rng.getrandbits(9) << 30 for _ in range(200)} | {rng.getrandbits(64) for _ in range(30)}
    x |= {v ^ 1 << 50 for v in list(x)[:20]}
    signed = [v - 2**64 if v >> 63 else v for v in x]
    tables = simhash.links(spark.createDataFrame([(v,) for v in signed], "print long"), crowd=crowd)
    edges = tables[0]
    for t in tables[1:]:
        edges = edges.union(t)
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    rows = list(zip(signed, x))
    assert [root.get(v, v) for v in signed] == classes(rows)
    assert len(tables) > 1


# Ranked search


def plain_terms(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_search(docs, items, best=50):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    n, total = sum(map(bool, counts)), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c in zip(docs, counts):
            m = c.total() and 100 - 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:best], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    words = [f"t{k}" for k in range(300)] + ["Straße", "a_b", "x-y", "日本"]
    prose = lambda n: " ".join(words[min(int(rng.expovariate(0.02)), 303)] for _ in range(n))
    docs = [(k, prose(rng.randrange(1, 120))) for k in range(400)]
    docs += [(400, None), (401, ""), (402, " .,;"), (403, "T1 t1 T1 t2"), (404, "t1 " * 200_000), (None, docs[7][1]), docs[7], docs[7]]
    docs += [(500 + k, docs[11][1]) for k in range(70)]  # ties beyond the 50th
    items = [(1, prose(30)), (2, "t1"), (3, docs[11][1]), (4, None), (5, "?!"), (6, "unheard words"), (None, prose(5)), (7, "T1, t1; t2"), (8, "日本 straße")]
    return docs, items


@pytest.fixture(scope="module")
def searched(spark):
    docs, items = corpus()
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS rank", "'y' AS term", "0 AS item").repartition(6), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS rank", "1 AS doc_id")


def test_search_as_plain_scores(spark, searched, tmp_path):
    docs, items, d, q = searched
    d.write.parquet(f"{tmp_path}/documents.parquet")
    q.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_lexical(spark, str(tmp_path))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items)


def test_search_over_small_segments_and_in_blocks_of_items(spark, searched, monkeypatch):
    docs, items, d, q = searched
    monkeypatch.setattr(lexical, "ITEMS", 4)
    index = lexical.Index(d, segment_rows=9)
    assert index.rows.select("segment").distinct().count() > 40
    assert sorted((tuple(r) for r in index.search(q, best=7).collect()), key=repr) == plain_search(docs, items, 7)


def test_search_of_nothing(spark, searched):
    _, _, d, q = searched
    assert lexical.Index(d.limit(0)).search(q).collect() == []
    assert lexical.Index(d).search(q.limit(0)).collect() == []


def test_blocks_are_skipped():
    """Documents 0 to 9,999 hold a weak term, three of them a strong one: the blocks of the others stay packed."""
    lengths = np.full(10_000, 10)
    weak, strong = np.arange(10_000), np.array([50, 5000, 9000])

    def posted(docs):
        gaps = np.diff(docs, prepend=0)
        gaps[:: lexical.BLOCK] = 0
        raw, size = lexical.vbyte(np.column_stack([gaps, np.ones(len(docs), np.int64)]).ravel())
        at = np.arange(0, len(docs), lexical.BLOCK)
        ends = np.cumsum(size)[1::2]
        most = lexical.impacts(np.ones(len(at), np.int64), lengths[docs[at]], 10_000, 100_000)
        return np.column_stack([docs[at], docs[np.minimum(at + lexical.BLOCK, len(docs)) - 1], np.concatenate([[0], ends[at[1:] - 1]]), most]), raw

    read = []
    plain = lexical.unvbyte
    lexical.unvbyte = lambda raw: (read.append(len(raw)), plain(raw))[1]
    try:
        docs, scores = lexical.block_max([(10, *posted(weak)), (5000, *posted(strong))], lengths, 1, 3, 10_000, 100_000)
    finally:
        lexical.unvbyte = plain
    assert sorted(docs[np.lexsort((docs, -scores))][:3].tolist()) == [50, 5000, 9000]
    assert sum(read) < len(posted(weak)[1]) / 5


def test_vbyte_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31, 2**34])
    raw, size = lexical.vbyte(x)
    assert (lexical.unvbyte(raw) == x).all() and size.sum() == len(raw)
