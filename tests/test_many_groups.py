"""Folds over very many small groups: rows in one stream, no frame for each group."""

from sparkloom.operators import folds


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_spans_and_offsets_of_many_keys(spark):
    rows = [(k, 0.0 + 10 * n, 15.0 + 10 * n, float(k % 3)) for k in range(3000) for n in range(2)] + [(None, 0.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "u int, a double, b double, o double").repartition(4)
    merged = folds.merge_pieces(df, ["u"], "a", "b", "o")
    assert sorted((r.u, r.a, r.b, r.o) for r in merged.collect()) == [(k, 0.0, 25.0, float(k % 3)) for k in range(3000)]
    trimmed = folds.trim_overlaps(df.withColumn("o", (df.o + 1).cast("long")), ["u"], "a", "b", "o")
    assert sorted((r.u, r.a, r.b) for r in trimmed.collect()) == [(k, *span) for k in range(3000) for span in ((0.0, 15.0), (15.0, 25.0))]
    grouped = folds.group_by_offset(df, ["u"], "a", "o")
    assert {(r.u, r.group) for r in grouped.collect()} == {(k, 0) for k in range(3000)}
    for out in (merged, trimmed, grouped):
        assert "FlatMapGroupsInPandas" not in plan(out)


def test_rows_of_a_group_stay_together(spark):
    """Groups that reach over batches, values that are null and whole numbers beyond a double's."""
    big = 2**53 + 1
    rows = [(float("nan") if k % 4 == 0 else k % 4 + 0.5, n, big if n % 2 else None) for n, k in enumerate(range(24_000))]
    df = spark.createDataFrame(rows, "k double, n long, v long").repartition(3)
    got = folds.by_rows(df, ["k"], ["n"], lambda p: [(p[0][0], len(p), p[-1][2], sorted(r[1] for r in p) == [r[1] for r in p])], ["k", "many", "v", "ordered"], {"many": "int", "ordered": "boolean"}).collect()
    assert sorted((str(r.k), r.many, r.v, r.ordered) for r in got) == [("1.5", 6000, big, True), ("2.5", 6000, None, True), ("3.5", 6000, big, True), ("nan", 6000, None, True)]


def test_a_clear_place_is_sought_where_words_are_shared(monkeypatch):
    """Places that cannot come near the best are not aligned; what is found is what trying all finds."""
    import random

    from sparkloom.functions import align

    def by_all(line, words, times, apart=20, by=2):
        n, tried = len(line), []
        for s in range(0, max(1, len(words) - n // 2), 2):
            blocks = blocks_of(line, words[s : s + n + 6])
            if blocks:
                run = align._first_run(blocks)
                tried.append((sum(b.size for b in blocks), s + run.b, run.a, s + blocks[0].b, s + blocks[-1].b + blocks[-1].size - 1))
        if not line or not tried:
            return None, 0.0
        best = max(tried)
        if any(x[0] >= best[0] - by for x in tried if times[x[4]] < times[best[3]] - apart or times[x[3]] > times[best[4]] + apart):
            return None, 0.0
        return float(times[best[1]]) - 0.3 * best[2], best[0] / n

    blocks_of, asked, rng = align._blocks, [], random.Random(7)
    monkeypatch.setattr(align, "_blocks", lambda a, b: asked.append(1) or blocks_of(a, b))
    for k in range(400):
        vocabulary = [chr(97 + c) for c in range(rng.choice([2, 5, 26]))]
        line, words = ([rng.choice(vocabulary) for _ in range(rng.randrange(m))] for m in (12, 50))
        if k % 2:
            words[7:7] = [w for w in line if rng.random() > 0.15]
        times = [2.0 * j for j in range(len(words))]
        want = by_all(line, words, times)
        assert align.find_unique(line, words, times) == want
        for least in (0.6, 0.8):
            sure = want if want[0] is not None and want[1] >= least else None
            have = align.find_unique(line, words, times, least=least)
            assert (have if have[0] is not None else None) == sure
    asked.clear()
    words = [f"w{int(abs(rng.gauss(0, 60)))}" for _ in range(1200)]
    t, share = align.find_unique(words[500:600], words, [0.35 * k for k in range(1200)])
    assert t == 175.0 and share == 1.0 and len(asked) < 60  # of 575 places


def test_only_open_rows_meet_the_vocabulary(spark):
    """Rows that say something by themselves are left out of the join with the vocabulary."""
    from sparkloom.operators import scraps

    rows = [("a", "plain words here"), ("b", "ab cd"), ("c", "xq zw"), ("d", None), ("e", "- -"), ("f", "Ab"), ("g", "it's t0")]
    df, words = spark.createDataFrame(rows, "id string, t string"), spark.createDataFrame([("ab",)], "word string")
    out = scraps.with_scraps(df, "id", "t", words)
    assert {r.id: r.scraps for r in out.collect()} == {"a": False, "b": False, "c": True, "d": True, "e": False, "f": False, "g": True}
    assert "Filter NOT _clean" in plan(out)


def test_runs_become_objects_one_at_a_time(spark):
    """No batch of runs is turned into Python objects at once."""
    from sparkloom.operators import timing

    said = ["alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu"]
    lines = [(c, k, 100.0 if k == 0 else None, k == 0, t.split()) for c in range(50) for k, t in enumerate(said)]
    words = [(c, 100.0 + 20 * k + j, 100.4 + 20 * k + j, 10 * k + j, w) for c in range(50) for k, t in enumerate(said) for j, w in enumerate(t.split())]
    l = spark.createDataFrame(lines, "c int, turn long, at double, timed boolean, tokens array<string>")
    w = spark.createDataFrame(words, "c int, g double, end double, seq long, token string")
    out = timing.timed_by_speech(l, w, ["c"], "turn", "at", "timed", "tokens")
    want = {(c, k, at, how) for c in range(50) for k, at, how in ((0, 100.0, None), (1, 120.0, "found"), (2, 140.0, "found"))}
    assert {(r.c, r.turn, r["at"], r.how) for r in out.collect()} == want
    assert "ArrowEvalPython" not in plan(out)


def test_greedy_pairs_of_many_small_groups_keep_long_numbers(spark):
    from sparkloom.operators import transcripts

    big = 2**53
    one = [(1, big + 1, 0.9), (1, big + 3, 0.9), (1, None, 0.9), (2, big + 1, 0.8), (2, big + 3, 0.7), (3, big + 1, 1.0), (3, None, 0.65), (4, big + 5, 0.6), (4, big + 5, None), (None, big + 7, 0.9)]
    rows = [(k, *r) for k in (*range(300), None) for r in one]
    out = transcripts.greedy_pairs(spark.createDataFrame(rows, "k long, l long, r long, s double"), ["k"], "l", "r", "s", 0.6)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    want = [(1, big + 1, 0.9), (2, big + 3, 0.7), (3, None, 0.65)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((k, *w) for k in (*range(300), None) for w in want), key=str)
