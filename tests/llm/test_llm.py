"""The ten operators and the pipeline against brute force, on a small table with awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, components, decontam, jaccard_join, langid, maxent_lm, media, pii, queries, resharding, suffix_dedup, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    rng = random.Random(3)
    syl = ["the", "re", "on", "in", "st", "er", "ha", "ou", "le", "ing", "ü", "é"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(150), prose(60)
    texts = [None, "", "   ", "one two", "word", "\n\n \t", "🙂🙂 !!! 123", "a" * 300, base, base, base + " end", base.replace("the", "THE", 2)]
    for k in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(8)]
    texts += [prose(rng.randrange(5, 90)) for _ in range(14)]
    texts += ["mail bo.b@ex-a.com and a@b.co_c@d.ef at 1.2.3.4 or 1.2.3.4.5.6.7.8 or 300.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (650) 555-0100 or +123", "id AB12345X seen; id 192.168.0.1; id 10.0.0.7; id 10.1.1.1; id CD99887Y"]
    texts += [prose(30) + " " + " ".join(BENCH[1].split()[3:16]).upper() + " tail", "x " + BENCH[0] + " y", "short, short"]
    rows = [(k, t, ["en", "fr"][k % 2] if k % 7 else None, f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[8], rows[12]]  # repeated rows


BENCH = {0: "Short, short?", 1: " ".join(f"q{k} w{k % 5}" for k in range(20)), 2: "", 3: None}


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "sig", "ids", "score", "key", "row", "_hash", "leaks", "language", "doc", "tie")}).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(BENCH.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty_sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(spark, sf, name):
    return sorted((tuple(r) for r in queries.QUERIES[name](spark, sf).collect()), key=lambda r: (r[0], repr(r)))


def check(spark, sf, name, rows, want, width):
    have = got(spark, sf, name)
    expected = sorted([(r[0], *want(r)) for r in rows], key=lambda r: (r[0], repr(r)))
    assert [r[:width] for r in have] == expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_sf, name):
    assert queries.QUERIES[name](spark, empty_sf).collect() == []


def test_op1(spark, sf, rows):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in BENCH.items():
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))

    def want(r):
        w, hit, items = word.findall(low(r[1])), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    items |= ids
        return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)

    check(spark, sf, "op1_decontamination", rows, want, 6)
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = decontam.find_leaks(docs, bench, "found").select("doc_id", "found").collect()
    two = decontam.find_leaks(docs, bench, "found", block_bytes=1).select("doc_id", "found").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    assert "sig" in decontam.find_leaks(docs, bench, "found", block_bytes=1).columns
    text = dict((r[0], r[1]) for r in rows)
    spans = [(r.doc_id, x) for r in one for x in r.found.ranges]
    assert spans and all(len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text[d][x.char_from : x.char_to])) == x.word_to - x.word_from for d, x in spans)


def test_decontam_runs_and_names(spark):
    """Windows at any place of long items, items of one text, and items without an id."""
    rng = random.Random(3)
    items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))) for k in range(30)] + [("x", "A b. c"), ("y", "a, B c!"), (None, "a b c"), (None, "q " * 30)]
    texts = [" ".join(rng.choice("abcq") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["ü A-b--c " + "q " * 12]
    found = decontam.Items([(n, t.encode()) for n, t in items])
    for t in texts:
        w, hit, names = re.findall("[a-zü]+", low(t)), set(), set()
        for n, i in items:
            v = re.findall("[a-z]+", low(i))
            for k in range(max(1, len(v) - 9)):
                for j in range(len(w) - min(10, len(v)) + 1):
                    if w[j : j + min(10, len(v))] == v[k : k + 10]:
                        hit |= set(range(j, j + min(10, len(v))))
                        names.add(n)
        got = decontam.scan(found, t.encode())
        assert {k for r in got["ranges"] for k in range(r["word_from"], r["word_to"])} == hit and set(got["items"]) == names
        assert all(len(re.findall("[A-Za-zü]+", t[r["char_from"] : r["char_to"]])) == r["word_to"] - r["word_from"] for r in got["ranges"])


PII = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def pii_valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        digits = [int(c) * (1 + k % 2) for k, c in enumerate(d[::-1])]
        return 12 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in digits) % 10 == 0
    return True


def pii_base(t):
    return sorted((m.start(), k, kind, m.end()) for k, kind in enumerate(PII) for m in re.finditer(PII[kind], t or "") if pii_valid(kind, m[0]))


def test_op2(spark, sf, rows):
    def want(r):
        s = pii_base(r[1])
        return *(sum(x[2] == k for x in s) for k in PII), sha(",".join(f"{k}:{a}:{e}" for a, _, k, e in s))

    check(spark, sf, "op2_pii", rows, want, 6)


def test_pii_awkward(spark):
    texts = ["a@b.c_d@e.f", "x" * 5000 + "@" + "y.z" * 900, "1" * 9000, "1 2 3" * 800, "00256.1.1.1 00255.0.0.0 1100.1.1.1 1.2.3.4100 0.00.000.0000", "1.1.1.1.1", "+1 2 3 4 5 6 7 8 9 (", "4111 1111 1111 1111  4111111111111111", "1-2-" * 2000 + "3", "++12345678901", "a@b", "a@b.", "é@b.cc", "5.5.5.5\n6.6.6.6"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    have = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert have == {k: ",".join(f"{x}:{a}:{e}" for a, _, x, e in pii_base(t)) for k, t in enumerate(texts)}


def test_pii_bootstrap(spark):
    texts = [f"please mail u{k}@x.org now, badge QX{k}77Z{k}" for k in range(20)] + ["please mail ZZ99-8877 now"] + ["plain A1B2C3D4 text"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    have = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.listed(F.col("all")).alias("s")).collect()}
    assert "id:12:21" in have[20] and have[21] == ""
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[20] == "please mail <id> now"


def test_pii_generations(spark):
    """Seeds make one context trusted, what it finds makes another one trusted, and so on; contexts
    that seeds share with many other numbers are not trusted."""
    rng = random.Random(6)
    code = lambda: f"{rng.choice('QRST')}{rng.randrange(10**5, 10**6)}-{rng.randrange(10, 99)}"
    codes = [code() for _ in range(110)]
    texts = [f"the contact is u{k}@x.org here" for k in range(60)] + [f"the contact is {c} here" for c in codes[:50]]
    texts += [f"our badge number {c} opens" for c in codes[:80]] + [f"asset tag {c}; next" for c in codes[30:110]]
    texts += [f"part {code()} costs 12345.67 or {rng.randrange(10**6)} at 10.1.1.{k}" for k in range(150)]
    texts += [f"value {rng.randrange(10**5, 10**6)} rose" for _ in range(300)] + [f"value 10.2.2.{k} rose" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(x.split(":")) for x in r.s.split(",") if x] for r in pii.find(df).select("doc_id", pii.listed(F.col("all")).alias("s")).collect()}
    ids = {k: {texts[k][int(a) : int(z)] for kind, a, z in v if kind == "id"} for k, v in found.items()}
    planted = [(k, c) for k, t in enumerate(texts) for c in codes if c in t]
    assert sum(c in ids[k] for k, c in planted) >= 0.9 * len(planted)
    assert sum(map(len, ids.values())) <= len(planted) / 0.9
    assert any(c in ids[k] for k, c in planted if "tag" in texts[k]) and not any(ids[k] for k, t in enumerate(texts) if t.startswith("value"))
    key = "token = " + '"' + "0a1b2c3d" * 5 + '"'
    assert [r.s for r in pii.find(spark.createDataFrame([(1, key)], "doc_id long, text string")).select(pii.listed(F.col("all")).alias("s")).collect()] == ["key:9:49"]


def test_pii_of_very_long_texts(spark):
    """Many entities, and one token of a megabyte, in about linear time."""
    many = "é " + " ".join(f"u{k}@x.org" for k in range(50_000))
    texts = [many, "x" * 1_000_000 + "1", "a@b.cc " * 100 + "9" * 1_000_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begin = time.time()
    have = {r.doc_id: (r.n, r.s) for r in pii.find(df).select("doc_id", F.size("base").alias("n"), pii.listed(F.slice("base", 49_999, 2)).alias("s")).collect()}
    assert have[0][0] == 50_000 and have[2][0] == 100 and have[1][0] == have[3][0] == 0
    ends = [m.span() for m in re.finditer(PII["email"], many)][-2:]
    assert have[0][1] == ",".join(f"email:{a}:{z}" for a, z in ends)
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[0] == "é " + " ".join(["<email>"] * 50_000) and text[3] is None
    assert time.time() - begin < 60


def test_op3(spark, sf, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation(), tok.no_padding()

    def want(r):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False))

    check(spark, sf, "op3_bpe", rows, want, 4)


def test_bpe_awkward():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    own = bpe.Bpe(open(queries.tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(1)
    texts = ["a\n \nb", "a  b", " a", "a  ", "\n a", "\t\t b", " \n a", "<|endoftext|>x <|endoftext|>", "don't 'S 's", "x" * 3000, "\x1c \x85 \u3000 \u00a0y", "12½ ²³", "日本語"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(500)]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == tok.decode(ids, skip_special_tokens=False)


def test_op4(spark, sf, rows):
    have = got(spark, sf, "op4_langid")
    assert len(have) == len(rows)
    for r, (i, held, lang, score) in zip(sorted(rows), have):
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1
        letters = any(map(str.isalpha, r[1] or ""))
        assert lang in ("en", "fr") if letters else (lang, score) == ("und", 0.0)


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    ok = langid.predict(docs.where("doc_id % 2 = 1"), model).agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int"))).first()[0]
    assert ok > 0.98
    few = langid.train(docs.where("doc_id % 2 = 0"), sample_rows=100, features=5000)
    assert 0 < sum(len(x[0]) for x in few.levels) <= 5000
    assert langid.predict(docs.where("doc_id % 2 = 1"), few).agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int"))).first()[0] > 0.9


def test_langid_against_plain_python(spark, monkeypatch):
    """The array operations against word and n-gram counters, with long texts cut and ties."""
    monkeypatch.setattr(langid, "STEP_CHARS", 64)
    rng = random.Random(7)
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7)))
    docs = [(k, " ".join(word("abcdé" if k % 2 else "cdefgñ") for _ in range(rng.randrange(1, 60))), "xx" if k % 2 else "yy") for k in range(60)]
    docs += [(60, None, "xx"), (61, "abc", None), (62, "123 _ !", "yy")]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    find = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: [w] if n == 0 else [e[k : k + n] for e in [w if n == 1 else f"_{w}_"] for k in range(len(e) - n + 1)]
    c = {(l, n): Counter() for l in ("xx", "yy") for n in range(5)}
    for _, t, l in docs:
        for w in find(t) if t and l else ():
            for n in range(5):
                c[l, n].update(grams(w, n))
    known = [set(c["xx", n]) | set(c["yy", n]) for n in range(5)]
    p = lambda l, n, g: math.log((c[l, n][g] + 0.5) / (sum(c[l, n].values()) + 0.5 * max(len(c["xx", n]), len(c["yy", n]))))
    texts = [t for _, t, _ in docs] + [" ".join(word("abcdefgéñz") for _ in range(40)) for _ in range(20)] + ["", "zzz", "9", "Ab" * 300]
    lang, score = model.predict(texts)
    for t, k, s in zip(texts, lang, score):
        if not any(map(str.isalpha, t or "")):
            assert (k, s) == (-1, 0.0)
            continue
        sums = dict.fromkeys(("xx", "yy"), 0.0)
        for w in find(t) if len(t) < 600 else [t.lower()[a : a + 64] for a in range(0, 600, 64)]:
            n = 0 if w in known[0] else next((n for n in range(4, 0, -1) if set(grams(w, n)) & known[n]), None)
            got = [g for g in grams(w, n) if g in known[n]] if n is not None else []
            for l in sums:
                sums[l] += sum(p(l, n, g) for g in got) / max(1, len(got))
        best = max(sums, key=lambda l: (sums[l], l == "xx"))
        assert model.langs[k] == best
        assert s == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), abs=1e-5)


def test_op5(spark, sf, rows):
    seen, cut = set(), {}
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        cut[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone) if not g)))
    assert sum(x[1] for x in cut.values()) > 2000
    check(spark, sf, "op5_suffix_dedup", rows, lambda r: cut[r[0]], 5)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for hot in (10, 1):
        have = {r.doc_id: (r.removed, r.spans, r.h) for r in suffix_dedup.remove(docs, hot=hot).select("doc_id", "cut.removed", "cut.spans", F.sha2("cut.kept", 256).alias("h")).collect()}
        assert have == {i: x[1:] for i, x in cut.items()}


def test_dedup_batches_and_clashes(spark, sf, rows, tmp_path):
    """Three batches in order of ids equal one; a reopened index goes on; columns of any name stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in ("_doc", "_tie", "_ranges", "seq", "place", "kind")))
    show = lambda df: df.select("doc_id", "_doc", "_tie", "_ranges", "seq", "cut.removed", "cut.spans", F.hex("cut.kept")).collect()
    one = show(suffix_dedup.remove(docs))
    assert {tuple(r[1:5]) for r in one} == {("own _doc", "own _tie", "own _ranges", "own seq")}
    folder, many = f"file://{tmp_path}/index", []
    for a, z in ((0, 12), (12, 13), (13, 30), (30, 1000)):
        index = suffix_dedup.Index(spark, folder)
        many += show(index.add(docs.where(F.col("doc_id").between(a, z - 1)), hot=10 if a else 10_000))
    assert sorted(many) == sorted(one) and [x.batches for x in index.levels] == [4]


def test_family_of_suffix_arrays(monkeypatch):
    """Random stretches around two anchors, in small batches, against all pairs."""
    import pyarrow as pa

    rng = random.Random(2)
    raws, lefts, lows = [], [], []
    for k in range(160):
        left = rng.randrange(0, 77)
        low = rng.randrange(0, left + 1)
        text = bytes(rng.choice(b"ab") if rng.random() < 0.015 else 97 for _ in range(76)) + (b"ANCHOR--", b"another-")[k % 2] * 3 + bytes(rng.choice(b"\xffb") if rng.random() < 0.015 else 97 for _ in range(76))
        raws.append(text[76 - left : 76 + 100 - low])
        lefts.append(left)
        lows.append(low)
    monkeypatch.setattr(suffix_dedup, "BATCH", 7)
    n = len(raws)
    names = ["key", "seq", "doc", "tie", "anchor", "left", "low", "bytes"]
    batch = pa.record_batch([pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array([0] * n), pa.array([1000] * n), pa.array(lefts, pa.int32()), pa.array(lows, pa.int32()), pa.array(raws, pa.binary())], names)
    have = {(r["doc"], r["first"], r["last"]) for b in suffix_dedup.match([batch]) for r in b.to_pylist()}
    seen, want = set(), set()
    for k in range(n):
        strings = {p: (p, raws[k][lefts[k] - p : lefts[k] - p + 100]) for p in range(lows[k], lefts[k] + 1)}
        again = [p for p, s in strings.items() if s in seen]
        if again:
            want.add((k, 1000 - max(again), 1000 - min(again) + 100))
        seen |= set(strings.values())
    assert have == want and len(want) > 20


def test_dedup_of_long_texts(spark, monkeypatch):
    """Texts are cut where they exceed the bytes that are hashed at a time."""
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", 500)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    raws = {0: text, 1: "x" + text[700:1900] + "y" + text[100:400], 2: text[:1200] * 2}
    b = {k: v.encode() for k, v in raws.items()}
    import pyarrow as pa

    batch = pa.record_batch([pa.array([0] * 3), pa.array(list(b)), pa.array([0] * 3), pa.array([raws[k] for k in b])], ["seq", "doc", "tie", "text"])
    got = pa.Table.from_batches(list(suffix_dedup.posts([batch]))).to_pylist()
    starts = Counter()
    for r in got:
        if r["kind"] != 2 or not any(o is not r and o["kind"] == 0 and (o["doc"], o["place"]) == (r["doc"], r["place"]) for o in got):
            s, n = suffix_dedup.unpack(r["place"])
            starts.update((r["doc"], x) for x in range(s, s + n))
    assert starts == Counter((k, x) for k, v in b.items() for x in range(len(v) - 99))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_op6(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q#f", "https://a.example.org/en/2", "ftp://notexample.org/es/", "http://x.com/fr/", "http://x.com/de", "http://com/de/1", "http://x.com/a.org/b", "http://x.net?/fr/", "://org/", "http://é.com/de/ü", "http://m.x.net/ads/1", "http://x.net/" + "a" * 3000 + "/ads/", "http://org", "http://a://org/x", "http://b\n.com/de/\nq"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    have = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op6_urls(spark, str(tmp_path)).collect()}
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else None
        other = "block" if "/ads/" in path or ".m." in "." + host and path.endswith(".html") else "allow"
        assert have[k] == (host, path, rule[1] if rule else None, rule[2] if rule else other), u


def test_globs():
    rng = random.Random(4)
    rules = [url_rules.Rule("".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))), "".join(rng.choice("ab*?") for _ in range(rng.randrange(0, 9))), "x", 0) for _ in range(60)]
    texts = [("".join(rng.choice("ab") for _ in range(rng.randrange(9))), "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for _ in range(200)]
    auto = url_rules.ShiftAnd(rules)
    state = auto.run([h.encode() + b"\xff" + p.encode() for h, p in texts])
    assert auto.words > 1
    again = url_rules.Judge([url_rules.Rule("*." + r.host.replace("?", "") + t, r.path, "x", k % 7) for k, r in enumerate(rules) for t in ("", ".org", ".com")])
    hosts, paths = [h.encode() + x for h, _ in texts for x in (b".org", b".net", b"")], [p.encode() for _, p in texts for _ in range(3)]
    whole = url_rules.ShiftAnd(again.rules).run([b"." + h + b"\xff" + p for h, p in zip(hosts, paths)])
    fit = [[k for k, end in enumerate(url_rules.ShiftAnd(again.rules).ends) if int(w[end // 64]) >> (end % 64) & 1] for w in whole[:90]]
    want = [min(f, key=lambda k: (-again.rules[k].weight, k), default=-1) for f in fit]
    assert again.best(hosts, paths)[:90].tolist() == want and len(set(want)) > 3
    begin = time.time()
    url_rules.ShiftAnd([url_rules.Rule(f"*.site{k}.org", f"/path{k}*", "block", 1) for k in range(20_000)])
    assert time.time() - begin < 10
    glob = lambda g: re.compile(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."))
    for r, end in zip(rules, auto.ends):
        hit = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1)
        assert [bool(x) for x in hit] == [bool(glob(r.host).fullmatch(h) and glob(r.path).fullmatch(p)) for h, p in texts]


def test_op7(spark, sf, rows):
    def want(r):
        b = (r[1] or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        m = media.wav(p)
        return len(b), len(p), sha(p), zlib.crc32(p[-16:]), len(m), sha(m), media.feature(p)

    check(spark, sf, "op7_media", rows, want, 8)


def test_chunks_share():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, 60_000, np.uint8).tobytes()
    a, b = rng.integers(0, 256, 5_000, np.uint8).tobytes() + same, rng.integers(0, 256, 7_777, np.uint8).tobytes() + same
    x, y = media.split([a, b])
    assert b"".join(x) == a and b"".join(y) == b
    assert len(set(x) & set(y)) > 0.8 * len(set(x)) - 4
    assert media.split([b]) == [y]  # whatever lies before
    assert all(len(c) <= media.GREATEST for c in x + y) and media.split([b""]) == [[]]
    assert media.samples(media.wav(b"abc" * 64)) == b"abc" * 64


def test_op8(spark, sf, rows):
    have = queries.op8_resharding(spark, sf).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in have) == sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    n = Counter(r.shard for r in have)
    counts = [n.get(k, 0) for k in range(24)]
    assert max(counts) - min(counts) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in have)
    assert all(sorted(r.slot for r in have if r.shard == k) == list(range(n[k])) for k in n)


def test_flow_is_cheapest():
    rng = random.Random(6)
    for _ in range(20):
        old, new = rng.randrange(1, 5), rng.randrange(1, 4)
        s = {(i, c): (rng.randrange(0, 4), float(2**c)) for i in range(old) for c in range(2)}
        go = resharding.flow(s, old, new)
        total = sum(n for n, _ in s.values())
        got_n = Counter()
        for k, parts in go.items():
            assert sum(parts.values()) == s[k][0]
            for j, n in parts.items():
                got_n[j] += n
        counts = [got_n[j] for j in range(new)]
        assert max(counts) - min(counts) <= 1
        cost = sum(n * s[k][1] for k, parts in go.items() for j, n in parts.items() if j != k[0])
        # What must move: from each old shard the rows above its capacity, the smallest first, for
        # the best choice of the shards that take one more.
        base, extra = divmod(total, new)
        import itertools

        best = math.inf
        for more in itertools.combinations(range(new), extra):
            c = 0.0
            for i in range(old):
                sizes = sorted(w for (o, _), (n, w) in s.items() if o == i for _ in range(n))
                keep = base + (i in more) if i < new else 0
                c += sum(sizes[: max(0, len(sizes) - keep)])
            best = min(best, c)
        assert cost == pytest.approx(best)


def test_moved_bytes_are_fewest(spark):
    """Row sizes of one power of two: against the best choice of shards that take one more, each
    old shard moving its smallest rows."""
    import itertools

    rng = random.Random(12)
    for block_rows in (1_000_000, 1):
        rows = [(k, rng.choice((0, 0, 1, 2, 3)), rng.randrange(64, 128)) for k in range(61)]
        df = spark.createDataFrame(rows, "doc_id long, shard0 int, bytes long").withColumn("text", F.lit(""))
        have = resharding.reshard(df, F.col("shard0"), F.col("bytes"), new=5, block_rows=block_rows)[0].collect()
        assert sorted((r.doc_id, r.old_shard, r["size"]) for r in have) == sorted(rows)
        n = Counter(r.shard for r in have)
        assert max(n.values()) - min(n.values()) <= 1
        assert all(sorted(r.slot for r in have if r.shard == k) == list(range(n[k])) for k in n)
        sizes = {i: sorted(z for _, o, z in rows if o == i) for i in range(5)}
        base, extra = divmod(len(rows), 5)
        best = min(sum(sum(v[: max(0, len(v) - base - (i in more))]) for i, v in sizes.items()) for more in itertools.combinations(range(5), extra))
        assert sum(r["size"] for r in have if r.shard != r.old_shard) == best


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    # Shards 0 and 1 have what they may keep; shard 2 gives to 3. Ids repeat and are missing.
    at = [0] * 10 + [1] * 10 + [2] * 20
    docs = spark.createDataFrame([(None if k == 3 else k // 2, "x" * k, i, "own") for k, i in enumerate(at)], "doc_id long, text string, at int, _part string")
    rows, changed = resharding.reshard(docs, F.col("at"), resharding.size_of(F.col("text")), new=4, keep={"text": F.col("text"), "_part": F.col("_part")})
    assert changed == [2, 3]
    resharding.rewrite(rows, changed, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["shard=2", "shard=3"]
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(len(r.text) for r in back if r.shard == 3) == list(range(20, 30)) and {r._part for r in back} == {"own"}
    assert sorted(r.slot for r in back if r.shard == 3) == list(range(10))


def test_op8_moves_the_fewest_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = queries.op8_resharding(spark, "/root/testdata/sf0.01").select("size", "old_shard", "shard").collect()
    sizes = {i: sorted(r["size"] for r in rows if r.old_shard == i) for i in range(16)}
    base, extra = divmod(docs.count(), 24)
    cost = lambda i, keep: sum(sizes[i][: max(0, len(sizes[i]) - keep)])
    saved = sorted((cost(i, base) - cost(i, base + 1) for i in sizes), reverse=True)  # by one row more
    least = sum(cost(i, base) for i in sizes) - sum(saved[:extra])
    assert sum(r["size"] for r in rows if r.shard != r.old_shard) == least


def test_op9(spark, sf, rows):
    words = {r[0]: [*re.findall("[^\x20\x09-\x0d]+", low(r[1])), None] for r in rows}
    train = [words[r[0]] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    for i, held, tokens, known, total, base, score in got(spark, sf, "op9_maxent"):
        w = words[i]
        assert (held, tokens, known, total) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert base == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) and score < 0


def test_lm_small_head_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r for r in maxent_lm.score(docs, F.col("doc_id") % 4 != 0).collect()}
    b = {r.doc_id: r for r in maxent_lm.score(docs, F.col("doc_id") % 4 != 0, head_words=50).collect()}
    flat = {r.doc_id: r for r in maxent_lm.score(docs, F.col("doc_id") % 4 != 0, head_words=50, rounds=0).collect()}
    assert all(a[k].base_score == pytest.approx(b[k].base_score) and a[k].n_known == b[k].n_known for k in a)
    held = [k for k in b if b[k].held_out]
    assert sum(b[k].score for k in held) > sum(flat[k].score for k in held) > sum(b[k].base_score for k in held)
    other = {r.doc_id: r for r in maxent_lm.score(docs.repartition(16), F.col("doc_id") % 4 != 0, head_words=50).collect()}
    one = {r.doc_id: r for r in maxent_lm.score(docs.coalesce(1), F.col("doc_id") % 4 != 0, head_words=50).collect()}
    assert all(other[k].score == pytest.approx(one[k].score, rel=1e-7) for k in one)


def test_lm_against_plain_python(spark, monkeypatch):
    """Word factor with counts, classes, steps and sums in plain Python; classes by their bias only."""
    monkeypatch.setattr(maxent_lm, "COUNT_TOKENS", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [None, "new words here", "new a"]
    learnt = lambda k: k < 40
    name = lambda w: int(maxent_lm.tokens([w.encode()])[0][0]) if w else 1
    lists = [[name(w) for w in (t or "").split()] + [1] for t in texts]
    bucket = lambda x: int(maxent_lm.bucket(np.array([x], np.uint64))[0])
    pairs = [[(w, bucket(([0, *x])[k])) for k, w in enumerate(x)] for x in lists]
    c = Counter(w for k, x in enumerate(lists) if learnt(k) for w in x)
    seen = Counter(p for k, x in enumerate(pairs) if learnt(k) for p in x)
    n, v, limit = sum(c.values()), len(c), 9
    least = next(m for m in range(1, 10**6) if sum(x >= m for x in c.values()) <= limit)
    head = sorted((w for w in c if c[w] >= least), key=lambda w: (-c[w], w))
    kind, mass = {}, 0
    for w in head:
        mass += c[w]
        kind[w] = min(int(mass / sum(c[x] for x in head) * 15), 14)
    of = lambda w: kind.get(w, 15)
    sums = Counter()
    for w in c:
        sums[of(w)] += c[w] + 0.5
    sums[15] += 0.5
    prior = Counter()
    for w in c:
        prior[of(w)] += c[w]
    after = Counter()
    for (w, b), m in seen.items():
        after[of(w), b] += m
    z = {(k, b): sums[k] for k in range(16) for b in range(64)}
    weight = dict.fromkeys(seen, 0)
    for _ in range(2):
        for (w, b), m in seen.items():
            e = after[of(w), b] * (c[w] + 0.5) * math.exp(weight[w, b] / 31) / z[of(w), b]
            weight[w, b] = round(weight[w, b] + 62 * (m - e) / (max(m, e) + 1))
        z = {(k, b): sums[k] for k, b in z}
        for w, b in seen:
            z[of(w), b] += (c[w] + 0.5) * math.expm1(weight[w, b] / 31)
    want = [sum(math.log10((prior[of(w)] + 1) / (n + 16)) + math.log10(c[w] + 0.5) + weight.get((w, b), 0) / 31 / math.log(10) - math.log10(z[of(w), b]) for w, b in x) for x in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    have = {r.doc_id: r.score for r in maxent_lm.score(docs, F.col("doc_id") < 40, head_words=limit, rounds=0).collect()}
    assert [have[k] for k in range(len(texts))] == pytest.approx(want, rel=1e-3)
    # What follows a word in the corpus is likelier after it than other words that are as frequent.
    texts = [" ".join(f"a{j} b{j}" for j in rng.sample(range(60), 20)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, "a1 b1 a2 b2 a3 b3"), (101, "a1 b2 a2 b3 a3 b1")], "doc_id long, text string")
    for rounds in (0, 3):
        have = {r.doc_id: (r.score, r.base_score) for r in maxent_lm.score(docs, F.col("doc_id") < 100, rounds=rounds).where("doc_id >= 100").collect()}
        assert have[100][0] > have[101][0] + 1 and have[100][1] == pytest.approx(have[101][1])


def jaccard(rows):
    sets = {}
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(r[1]))
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_op10(spark, sf, rows):
    want = jaccard(rows)
    assert len({c for _, c in want.values()}) < len(want) - 10
    check(spark, sf, "op10_jaccard", rows, lambda r: want[r[0]], 3)


def test_keep_one_without_unique_keys(spark):
    """Missing and repeated keys: no text is lost but for near copies, of which one stays."""
    line = lambda k, *more: " ".join([*(f"w{k}x{j}" for j in range(40)), *more])
    a, b, c, d, e, f, g = map(line, range(7))
    rows = [(None, a), (None, b), (None, line(1, "more")), (7, c), (7, d), (7, d), (3, e), (9, line(4, "more")), (9, f), (None, line(2, "more")), (None, g), (None, g), (None, None), (None, ""), (5, " "), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1))
    have = Counter((r[0], r[1]) for r in jaccard_join.keep_one(docs).select("doc_id", "text").collect())
    near = [k for k in have if k in ((None, b), (None, line(1, "more")))]
    assert len(near) == 1 and have.pop(near[0]) == 1
    assert have == Counter([(None, a), (7, c), (7, d), (3, e), (9, f), (None, g), (None, None), (None, ""), (5, " "), (5, " ")])


def grouped(pairs, names):
    root = {k: k for k in names}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        root[find(a)] = find(b)
    return sorted(sorted(k for k in names if find(k) == r) for r in {find(k) for k in names})


def test_link_sets():
    """Against all pairs: overlapping random sets, small unrelated sets, and large groups of copies."""
    rng = np.random.default_rng(9)
    cases = [[np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]]
    cases += [[np.unique(rng.integers(0, 9, 6).astype(np.uint64)) for _ in range(80)]]
    base = [rng.integers(0, 10**9, 100).astype(np.uint64) for _ in range(3)]
    cases += [[np.unique(np.append(base[k % 3][rng.random(100) < 0.93], rng.integers(0, 10**9, 4).astype(np.uint64))) for k in range(120)]]
    for sets in cases:
        names = [bytes([k]) for k in range(len(sets))]
        want = []
        for a in range(len(sets)):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    want.append((names[a], names[b]))
        assert grouped(jaccard_join.link_sets(names, sets), names) == grouped(want, names)
    small = [np.arange(6 * k, 6 * k + 6, dtype=np.uint64) for k in range(20_000)]
    begin = time.time()
    assert jaccard_join.link_sets([b"%d" % k for k in range(len(small))], small) == [] and time.time() - begin < 20


def test_long_runs_and_blocks(spark, sf, rows, monkeypatch):
    """Shingles of over two classes are chained, and components cut into blocks of a few sets."""
    want = sorted((r[0], *jaccard(rows)[r[0]]) for r in rows)
    for run, block in ((2, 200), (1, 1000), (64, 200)):
        monkeypatch.setattr(jaccard_join, "RUN", run)
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
        assert sorted(tuple(r) for r in jaccard_join.link(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == want


def test_scan_of_runs():
    """Rows of a token in several batches, for short and long runs."""
    import pyarrow as pa

    rng = random.Random(2)
    posts = sorted((t, n, bytes([s])) for t in range(30) for s, n in {(rng.randrange(200), 0) for _ in range(rng.randrange(1, 9))})
    posts = [(t, 10 + s[0] % 7, s) for t, _, s in posts]
    posts = sorted(posts + posts[:20])
    was, jaccard_join.RUN = jaccard_join.RUN, 4
    try:
        batches = [pa.record_batch([pa.array([x[0] for x in p]), pa.array([x[2] for x in p], pa.binary()), pa.array([x[1] for x in p], pa.int32()), pa.array([2] * len(p), pa.int32())], ["token", "sig", "n", "l"]) for p in (posts[k : k + 3] for k in range(0, len(posts), 3))]
        have = Counter(tuple(r.values()) for b in jaccard_join.scan(batches) for r in b.to_pylist())
    finally:
        jaccard_join.RUN = was
    want = Counter()
    for t in range(30):
        own = sorted({(n, s) for u, n, s in posts if u == t})
        if len(own) <= 4:
            want.update((min(x, y), max(x, y), 2, 0) for i, (n, x) in enumerate(own) for m, y in own[i + 1 :] if 4 * m <= 5 * n)
        else:
            want.update((s, s, 0, 2) for _, s in own)
            want.update((x, y, 0, 1) for (n, x), (m, y) in zip(own, own[1:]) if 4 * m <= 5 * n)
    assert have == want


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    have = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert have == {x: find(x) for e in edges if e[0] != e[1] for x in e} | {x: find(x) for x in have}


def test_pipeline(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    a = corpus_pipeline.language(spark, docs, sf)
    kept = {r.doc_id for r in a.collect()}
    assert a.columns == columns and kept == {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
    b = corpus_pipeline.near_duplicates(spark, a, sf)
    want = jaccard([r for r in rows if r[0] in kept])
    assert b.columns == columns and sorted(r.doc_id for r in b.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    c = corpus_pipeline.decontamination(spark, b, sf)
    assert c.columns == columns and {r.doc_id for r in b.collect()} - {r.doc_id for r in c.collect()} == {r[0] for r in rows if r[1] and ("Q4 W4" in r[1] or "hort, short" in r[1])}
    d = corpus_pipeline.personal_data(spark, c, sf)
    texts = {r.doc_id: r.text for r in d.collect()}
    assert d.columns == columns and any("<email> and <email><email> at <ip>" in (t or "") for t in texts.values()) and not any(pii_base(t) for t in texts.values())
    e = corpus_pipeline.tokens(spark, d, sf).collect()
    assert len(e) == len(texts) and all(r.decodes for r in e)
    assert corpus_pipeline.run(spark, sf).count() == len(e)
