"""Steps whose cost at size was a finding: same results, less work."""

import random
from difflib import SequenceMatcher
from time import process_time


def _texts(rnd, letters, n):
    a = [rnd.choice(letters) for _ in range(n)]
    b = a[n // 3 :] + a[: n // 3]
    for _ in range(n // rnd.choice([3, 20, 200]) + 1 if n else 0):
        b[rnd.randrange(n)] = rnd.choice(letters)
    return "".join(a), "".join(b)


def test_ratio_is_that_of_the_standard_matcher():
    from sparkloom.functions import align

    rnd = random.Random(7)
    for letters in ("ab", "abcdefgh", "etaoinshrdlu" * 3 + "xyzq0123é", [chr(200 + k) for k in range(500)]):
        for n in (0, 1, 7, 60, 199, 200, 450, 900):
            for _ in range(6):
                a, b = _texts(rnd, letters, n)
                c, _ = _texts(rnd, letters, rnd.randrange(300))
                for x, y in ((a, b), (b, a), (a, c), (c, a), (a, a), ("", a)):
                    assert align.ratio(x, y) == SequenceMatcher(None, x, y).ratio()
    long = _texts(rnd, "abcdefgh", 5000)
    assert align.ratio(*long) == SequenceMatcher(None, *long).ratio()


def test_ratio_takes_less_than_half_of_the_standard_matchers_time():
    from sparkloom.functions import align

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("eeetttaaooiinnsshrdlucmfwypvbgkqjxz") for _ in range(n)) for n in (120, 150, 180, 400, 900, 1500) for _ in range(4)]
    pairs = [(x, y) for x in texts for y in texts]
    t = process_time()
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    plain, t = process_time() - t, process_time()
    assert [align.ratio(x, y) for y in texts for x in texts] == [want[len(texts) * i + j] for j in range(len(texts)) for i in range(len(texts))]
    assert process_time() - t < plain / 2


def test_rules_said_at_once_are_those_of_the_list(spark):
    import itertools
    from functools import reduce

    from pyspark.sql import functions as F

    from sparkloom.operators import repair

    words = ["".join(x) for n in range(6) for x in itertools.product("aSs.6", repeat=n)] + ["abc\n", "abcd\n", "été", "McAs", "Mcas", "O'Ab", "don't", "do'nt", '("a")', "abcd/efgh", "..", "a.b", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    listed = reduce(lambda rest, rule: F.when(w.rlike(rule[0]), rule[1]).otherwise(rest), reversed(repair._RULES[2:]), F.lit("sound"))
    whole = F.struct(*(F.regexp_extract("w", repair._WORD, k) for k in (1, 2, 3)))
    for r in df.select("w", repair.verdict(w).alias("v"), listed.alias("l"), repair.parts(w).alias("p"), whole.alias("q")).collect():
        assert r.v == r.l and (tuple(r.p) if r.p else None) == (tuple(r.q) if r.w is not None else tuple(r.p) if r.p else None), r


def test_mended_reads_its_texts_twice(spark, tmp_path):
    """Once for their words, once to put the mends in; each use of the words was a reading of its own."""
    from pyspark.sql import functions as F

    from sparkloom.operators import repair

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    vocabulary = spark.createDataFrame([("staging", 30), ("stating", 3), ("roger", 9)], "word string, n long")
    pairs = spark.createDataFrame([("roger", "staging", 4)], "first string, second string, n long")
    spark.createDataFrame([(k, f"Roger, sta6ing {k}") for k in range(20)], "id int, t string").write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t").withColumn("t", counted.asNondeterministic()("t"))
    out = repair.mended(texts, ["id"], "t", vocabulary, pairs).collect()
    assert {r.mended for r in out} == {f"Roger, staging {k}" for k in range(20)}
    assert seen.value <= 60


def test_readings_of_a_stream_without_a_key_go_on_over_buckets(spark):
    """A row goes on from a trusted row of an earlier bucket, also where the key is null."""
    from sparkloom.operators import folds, runs

    rnd, t, rows = random.Random(9), 0, []
    for k in range(400):
        t += rnd.randrange(0, 90)
        text = list(f"{t // 86400:02d}{t // 3600 % 24:02d}{t // 60 % 60:02d}{t % 60:02d}")
        text[rnd.randrange(8)] = "?"
        rows.append((None, k, t if k % 17 == 0 else rnd.randrange(40_000) if k % 11 == 5 else None, "".join(text), None))
    df = spark.createDataFrame(rows, "k string, at long, t long, pattern string, hour long")
    want = folds.resolved(*[[r[c] for r in rows] for c in (2, 3, 4)])
    for block in (1000, 25):
        got = runs.resolve_times(df, ["k"], "at", "t", "pattern", "hour", 10, block=block)
        assert [r["resolved"] for r in got.orderBy("at").collect()] == want


def test_texts_are_cut_into_words_once_for_their_grams(spark, tmp_path):
    """Each use of the words was a cut of its own, and documents were read twice, once to count hits."""
    from pyspark.sql import functions as F

    from sparkloom.functions import text
    from sparkloom.plans import texts

    cuts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all")
    words = text.tokens(F.col("text"))
    df = spark.createDataFrame([("It's one two, Three",), ("one two",), ("",), (None,)], "text string")
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert cuts(df.select(text.grams(words, 3).alias("g"))) == 1 and cuts(df.select(text.hashed_grams(words, 3).alias("g"))) == 1
    got = df.select("text", text.grams(words, 3).alias("g"), F.size(text.hashed_grams(words, 3)).alias("n")).collect()
    assert {r.text: r.g for r in got} == {"It's one two, Three": ["its one two", "one two three"], "one two": [], "": [], None: None}
    assert all(r.n == len(r.g) for r in got if r.g is not None)

    docs = spark.createDataFrame([(k, "a b c d") for k in range(3)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "x a b c")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = texts.trigram_vote(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [doc_id") == 1 and "Broadcast" not in plan
    assert [tuple(r) for r in out.collect()] == [("1:0", 0, 1.0)]


def test_rare_votes_are_those_of_plain_counting(spark):
    """With grams of many places, places that come twice, and a query's gram that comes twice."""
    from collections import defaultdict

    from sparkloom.operators import aggregates

    rnd = random.Random(11)
    index = [(rnd.randrange(60), int(rnd.random() ** 3 * 40)) for _ in range(400)]
    asked = [(f"q{rnd.randrange(12)}", rnd.randrange(50)) for _ in range(150)]
    got = aggregates.rare_votes(spark.createDataFrame(asked, "q string, gram long"), spark.createDataFrame(index, "place long, gram long"), "q", "gram", "place", 9, 8, 0.2)
    places, want = defaultdict(list), {}
    for p, g in index:
        places[g].append(p)
    for q in {q for q, _ in asked}:
        score = defaultdict(float)
        for g in {g for x, g in asked if x == q and len(places[g]) <= 9}:
            for p in places[g]:
                score[p // 8] += 1 / len(places[g])
        if score:
            s, b = max((round(v, 6), -b) for b, v in score.items())
            if round(max(score.values()), 2) >= 0.2:
                want[q] = (-b, round(max(score.values()), 2))
    assert {r.q: (r.bin, r.score) for r in got.collect()} == want and want
