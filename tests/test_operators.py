"""Small literal cases."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import align, clock, text
from sparkloom.operators import fixes, folds, intervals, joins, sequence, transcripts, writes
from sparkloom.sources import files, html
from sparkloom.streaming import counters


def test_runs_in_order():
    assert folds.increasing([10, 20, 5, 30, 25, 40], strict=True) == [0, 1, 4, 5]
    assert folds.increasing([1, None, 1, 0, 2], strict=False) == [0, 2, 4]
    assert folds.increasing([], strict=True) == []


def test_smudged_digits():
    assert folds.filled_digits("0002254?", 8740, 8755) == 8740
    assert folds.filled_digits("0002?541", 8730, 8735) is None
    assert folds.filled_digits("????2541", 0, 10**9) is None


def test_resolved_times():
    assert folds.resolved([1000, 1100, 1200, 1150, 1210, 1220], [None] * 6, [None] * 6) == [1000, 1100, 1100, 1150, 1210, 1220]
    assert folds.resolved([1000, None, 1300], [None, "000?2000", None], [None, None, None]) == [1000, 1200, 1300]
    assert folds.resolved([None, 900, None], [None] * 3, [None, None, 800]) == [None, 900, 900]




def test_trimmed_and_merged():
    assert folds.trimmed([(0, 100, 10), (90, 200, 10)]) == [(0, 100, 10), (100, 200, 10)]
    assert folds.trimmed([(0, 600, 1), (300, 400, 20)]) == [(0, 300, 1), (300, 400, 20)]
    assert folds.merged([(0, 10, 5), (5, 20, 8), (6, 9, 100)], 30) == [(0, 20, 5), (6, 9, 100)]


def test_offset_groups():
    assert folds.offset_groups([(0, 1), (10, 2), (20, 50), (30, 3), (2000, 3)], 600, 8) == [0, 0, 1, 0, 2]


def test_pinned(spark):
    p = spark.createDataFrame([("t", 0, 100, 1000), ("t", 100, 300, 500), ("t", 300, 600, 2300)], "k string, a long, b long, g long")
    pin = spark.createDataFrame([("t", 80, 320, 2080)], "k string, a long, b long, g long")
    assert sorted(tuple(r)[1:] for r in intervals.pinned(p, pin, "k", "a", "b", "g").collect()) == [(0, 80, 1000), (80, 320, 2080), (320, 600, 2320)]


def test_interpolated_frames(spark):
    df = spark.createDataFrame([("m", 5844.0, 1000.0), ("m", 5845.0, None), ("m", 5854.0, None), ("m", 5864.0, 2000.0), ("m", 5870.0, None)], "k string, x double, y double")
    assert [r.value_at for r in sequence.interpolate(df, ["k"], "x", "y").orderBy("x").collect()] == [1000, 1050, 1500, 2000, 2000]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof_and_nearest(spark, width):
    import random

    rng = random.Random(5)
    left = [(k, rng.randrange(60), n) for n, k in enumerate("abcab" * 12)]
    right = [(k, t, n) for n, (k, t) in enumerate({(k, rng.randrange(60)) for k in "abd" for _ in range(9)})]
    l, r = spark.createDataFrame(left, "k string, t long, n long"), spark.createDataFrame(right, "k string, u long, m long")
    for forward in (False, True):
        got = {x.n: x.match.m if x.match else None for x in joins.asof(l, r, ["k"], "t", "u", ["m"], width, forward=forward).collect()}
        for k, t, n in left:
            near = [(u, m) for q, u, m in right if q == k and (u >= t if forward else u <= t)]
            assert got[n] == ((min if forward else max)(near)[1] if near else None)
    got = {x.n: x.match.u if x.match else None for x in joins.nearest(l, r, ["k"], "t", "u", ["m"], width, tolerance=9).collect()}
    for k, t, n in left:
        near = min(((abs(u - t), u) for q, u, m in right if q == k), default=None)
        assert got[n] == (near[1] if near and near[0] <= 9 else None)


def test_band_and_interval(spark):
    l = spark.createDataFrame([(1, 10.0), (2, 25.0)], "i long, t double")
    r = spark.createDataFrame([(1, 5.0), (2, 12.0), (3, 31.0)], "j long, u double")
    assert sorted((x.i, x.j) for x in joins.band_join(l, r, [], "t", "u", 5, 6).collect()) == [(1, 1), (1, 2), (2, 3)]
    s = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 30.0)], "s long, a double, b double")
    assert sorted((x.i, x.s) for x in joins.interval_join(l, s, [], "t", "a", "b", 8).collect()) == [(1, 2), (2, 2)]


def test_clock(spark):
    df = spark.createDataFrame([("103:05:09",), ("-000:01:00",), ("15:30",), ("7",), ("x",)], "s string")
    assert [r[0] for r in df.select(clock.seconds(F.col("s"))).collect()] == [371109, -60, 930, 7, None]


def test_text(spark):
    df = spark.createDataFrame([("Don't <b>stop</b> &amp; go",)], "s string")
    assert df.select(text.tokens(F.col("s")), text.clean_html(F.col("s"))).first()[:] == (["dont", "b", "stop", "b", "amp", "go"], "Don't stop & go")


def test_alignment():
    words, times = "we have a good go for landing over".split(), [float(t) for t in range(8)]
    assert align.find("good go for".split(), words, times) == (3.0, 1.0)
    assert align.find_start("uh good go".split(), words, times)[0] == pytest.approx(2.7)
    assert align.find_start(["zz"], words, times) == (None, 0.0) and align.find_start(["zz", words[3]], words, times) == (pytest.approx(times[words.index(words[3])] - 0.3), 0.5)
    assert align.find_unique("go for landing".split(), words, times)[0] is not None
    assert align.find_unique("a b c".split(), ("a b c x y z " * 5).split() , [t * 10.0 for t in range(30)]) == (None, 0.0)
    known = {"the", "quick", "fox"}
    assert align.merged("the qick dog".split(), "the quick fox".split(), known) == ["the", "quick", "fox"]
    assert align.merged("the quick fox".split(), "the qick fox x".split(), known) == ["the", "quick", "fox", "x"]
    assert SequenceMatcher(None, "abc", "abd").ratio() == pytest.approx(2 / 3)


def test_writes(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k long, at long, v string")
    assert sorted(r.v for r in writes.first_write_wins(rows, ["k"], F.col("at")).collect()) == ["a", "b"]
    assert sorted(r.v for r in writes.last_write_wins(rows, ["k"], F.col("at")).collect()) == ["b", "c"]
    n = spark.createDataFrame([(1, 5)], "k long, n long")
    assert sorted(tuple(r) for r in writes.upsert_add(n, n.union(spark.createDataFrame([(2, 1)], "k long, n long")), ["k"], "n").collect()) == [(1, 10), (2, 1)]


def test_pages(spark):
    p = spark.createDataFrame([(1, '<h2>A</h2><p>x</p><p>y <a href="u">l</a><a href="u">m</a></p><h2>B</h2><p>z</p>')], "i long, h string")
    assert [tuple(r) for r in html.links(p, "i", "h").collect()] == [(1, "u", 0, "l")]
    assert [(r.section, r.text) for r in html.items_under_headings(p, "i", "h").orderBy("at").collect()] == [("A", "x"), ("A", "y l m"), ("B", "z")]


def test_files(spark, tmp_path):
    (tmp_path / "tape.json").write_text('[[0.5, 1.0, "Go!"], [1.0, 2.0, "for"]]')
    assert [tuple(r) for r in files.timed_words(spark, str(tmp_path / "tape.json")).collect()] == [("tape", 0, 0.5, 1.0, "Go!", "go"), ("tape", 1, 1.0, 2.0, "for", "for")]
    (tmp_path / "m.json").write_text('{"a": {"n": 1}, "b": {"n": 2}}')
    assert sorted((r.key, r.value.n) for r in files.json_map(spark, str(tmp_path / "m.json"), "struct<n:int>").collect()) == [("a", 1), ("b", 2)]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "m string, n long")
    files.write_partition(a, str(tmp_path / "out"), "m")
    files.write_partition(spark.createDataFrame([("x", 9)], "m string, n long"), str(tmp_path / "out"), "m")
    assert sorted((r.m, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("x", 9), ("y", 2)]


def test_stream_limit_and_upserts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):  # a stream takes files in the order of their times
        e.where(F.floor(F.col("event_id") / 334) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    s = counters.read_events(spark, str(tmp_path / "events"))
    counters.run_once(counters.under_limit(s, 1), "append", "limited", str(tmp_path / "c1"))
    want = e.select("user_id", F.to_date("ts")).distinct().count()
    assert spark.table("limited").count() == want
    q = counters.read_events(spark, str(tmp_path / "events")).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).alias("n")).writeStream.foreachBatch(counters.upsert_into(str(tmp_path / "state"), ["day"], "n")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = sorted(p.name for p in (tmp_path / "state").iterdir())[-1]
    assert spark.read.parquet(str(tmp_path / "state" / last)).agg(F.sum("n")).first()[0] == e.count()


def test_spoken_times():
    assert transcripts.number_words("one hundred and two") == 102
    assert [transcripts.number_words(t) for t in ("fifty-nine", "Two hundred", "hundred", "two hundred twelve", "zero", "17", "nineteen", "five twenty", "and", "ten hundred and twenty-one")] == [59, 200, 100, 212, 0, 17, 19, None, None, 1021]
    assert transcripts.number_words("forty five") == 45 and transcripts.number_words("hello") is None
    assert transcripts.said_times("now at one hundred and two hours and 45 minutes, or 102:45:40") == [(369900, "words"), (369940, "clock")]
    assert transcripts.said_times("400 hours") == [] and transcripts.said_times(None) == []


def test_blocks_and_readings():
    assert transcripts.block_streams(["x", "note", "x", "crew", "crew", "x", "note", "end"], {"crew"}) == [0, 1, 1, 1, 0, 0, 1, 0]
    assert transcripts.disagreements("we have a god go".split(), "we have a good go".split()) == [("god", "good")]
    assert transcripts.disagreements("the LOS, is 123 Karl and hte".split(), "the lls is 124 carl and the".split(), {("karl", "carl")}) == [("hte", "the")]
    assert transcripts.same_text("Roger, that.", "roger that") and not transcripts.same_text("Roger", "Go")


def test_correlation():
    import numpy as np

    rng = np.random.default_rng(0)
    s = rng.normal(size=200)
    k, r = transcripts.correlation(s.tolist(), (3 * s[70:110] + 5).tolist())
    assert k == 70 and r == pytest.approx(1.0)
    assert transcripts.correlation([1.0], [1.0, 2.0]) == (-1, 0.0)


def test_mp3_header():
    frame = bytes([255, 0b11111011, 0b10010000, 0])  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz
    assert transcripts.mp3_seconds(frame + bytes(400), 160_000) == pytest.approx(10.0)
    xing = frame + bytes(32) + b"Xing" + bytes([0, 0, 0, 1]) + (1000).to_bytes(4, "big")
    assert transcripts.mp3_seconds(xing + bytes(200), 1) == pytest.approx(1000 * 1152 / 44100)
    assert transcripts.mp3_seconds(b"ID3" + bytes(7) + frame + bytes(50), 16_010) == pytest.approx(1.0)
    assert transcripts.mp3_seconds(b"no header", 9) is None


def test_stitched_and_greedy(spark):
    df = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (1, 3, "c", False), (1, 4, "d", True)], "k long, n long, t string, s boolean")
    assert [(r.line, r.t) for r in transcripts.stitched(df, ["k"], "n", F.col("s"), "t").orderBy("line").collect()] == [(0, "a"), (1, "b c"), (2, "d")]
    c = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.95), (1, 2, 2, 0.5), (1, 3, 2, 0.7)], "k long, l long, r long, s double")
    assert sorted((x.l, x.r) for x in transcripts.greedy_pairs(c, ["k"], "l", "r", "s", 0.6).collect()) == [(1, 1), (3, 2)]
    w = spark.createDataFrame([(1, 10.0, 0.0), (1, 13.0, 5.0), (1, 15.0, 0.0)], "p long, y double, x double")
    assert [r.line for r in transcripts.grouped_by_height(w, ["p"], "y", "x").orderBy("y").collect()] == [0, 0, 1]
    b = spark.createDataFrame([(1, 0.0, "A", "we go"), (1, 5.0, "?", "on and"), (1, 9.0, "?", "on."), (1, 12.0, "?", "more")], "k long, g double, s string, t string")
    assert [r.t for r in transcripts.joined_broken_rows(b, ["k"], "g", "s", "t").orderBy("g").collect()] == ["we go on and on.", "more"]


def test_chain():
    import random

    rng = random.Random(3)
    assert folds.chain([]) == [] and folds.chain([(0, 5), (1, 6), (2, 1), (3, 7)]) == [0, 1, 3]
    for _ in range(60):
        p = [(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 12))]
        got = folds.chain(p)
        assert all(p[a][0] < p[b][0] and p[a][1] < p[b][1] for a, b in zip(got, got[1:]))
        best = [1] * len(p)
        order = sorted(range(len(p)), key=lambda k: p[k])
        for b in order:
            best[b] = 1 + max((best[a] for a in order if p[a][0] < p[b][0] and p[a][1] < p[b][1]), default=0)
        assert len(got) == max(best)


def test_fixes(spark):
    lines = spark.createDataFrame([(11, 1, 10.0, "A", "we hve a go"), (11, 2, 11.0, "B", "roger"), (11, 3, 50.0, "A", "noise"), (11, 4, 5000.0, "A", "end")], "mission int, line long, g double, s string, t string")
    rows = [
        (11, 1, 10.5, "replace", "hve", "have", None, None), (11, 2, 10.0, "set", "we", None, "CC", None), (11, 3, 50.0, "delete", None, None, None, None), (11, 4, 50.0, "ok", None, None, None, None),
        (11, 5, 4000.0, "retime", "end", None, None, 4999.0), (11, 6, 10.0, "ok", "roger", None, None, None), (11, 7, 9.0, "replace", "absent", "x", None, None),
    ]
    fx = spark.createDataFrame(rows, "mission int, fix long, g double, verb string, from string, to string, speaker string, at double")
    assert sorted(tuple(r)[1:] for r in fixes.applied(lines, fx).collect()) == [(1, 10.0, "CC", "we have a go", False, False), (2, 11.0, "B", "roger", True, False), (4, 4999.0, "A", "end", False, False)]
    assert [r.fix for r in fixes.unmatched(lines, fx).collect()] == [7]


def test_lines_parted_and_rejoined(spark):
    lines = spark.createDataFrame(
        [(1, 1, 10.0, "A", "Go ahead. Roger, go. Out."), (1, 2, 12.0, "B", "we are"), (1, 3, 20.0, "B", " here now"), (1, 4, 30.0, "B", " here too"), (1, 5, 500.0, "C", None), (2, 1, 12.0, "B", "here"), (1, 6, 900.0, "D", "a"), (1, 7, 901.0, "D", "b c"), (1, 8, 902.0, "D", "d")],
        "mission int, line long, g double, s string, t string",
    )
    make = lambda rows: spark.createDataFrame(rows, "mission int, fix long, g double, from string, to string, speaker string")
    cuts = make([(1, 1, 10.0, "Go", "Roger", "CC"), (1, 2, 10.0, "Go", "Out", "A"), (1, 3, 10.0, "Go", "absent", "X"), (1, 4, 10.0, "Go", "Roger", "CDR"), (1, 5, 10.0, "Go", "Go", "X")])
    got = sorted((r.line, r.part, r.s, r.t) for r in fixes.parted(lines, cuts).where("mission = 1 and line <> 5").collect())
    assert got[:3] == [(1, 0, "A", "Go ahead."), (1, 1, "CDR", "Roger, go."), (1, 2, "A", "Out.")]
    assert got[3:] == [(2, 0, "B", "we are"), (3, 0, "B", " here now"), (4, 0, "B", " here too"), (6, 0, "D", "a"), (7, 0, "D", "b c"), (8, 0, "D", "d")]
    assert fixes.parted(lines, cuts).where("line = 5").select("part", "s", "t").collect() == [(0, "C", None)]
    joins_ = make([(1, 1, 12.0, "we", " here", None), (1, 2, 900.0, "a", "b", None), (1, 3, 901.0, "b", "d", None), (1, 4, 10.0, "Go", "nothing", None)])
    once = fixes.rejoined(lines, joins_)
    assert sorted((r.line, r.t) for r in once.where("mission = 1 and g < 400").collect()) == [(1, "Go ahead. Roger, go. Out."), (2, "we are here now"), (4, " here too")]
    assert sorted((r.line, r.t) for r in once.where("g >= 900").collect()) == [(6, "a b c"), (8, "d")]
    assert [r.t for r in fixes.rejoined(once, joins_).where("g >= 900").collect()] == ["a b c d"]
    assert once.where("mission = 2").count() == 1 and fixes.rejoined(lines, joins_.limit(0)).count() == lines.count()


def test_align_share_of_a_hot_passage(spark, tmp_path):
    """A passage that 25 documents hold aligns with each of them."""
    from sparkloom.plans import texts

    passage = "one two three four five six"
    docs = [(k, f"start{k} {passage} end{k}") for k in range(25)] + [(99, "one two three four seven eight")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    have = sorted(map(tuple, texts.align_share(spark, str(tmp_path)).collect()))
    assert have == [(1, k, 4, 1.0, 1.0) for k in range(25)]


def test_groups_cut_at_gaps(spark):
    """Folds over clusters equal folds over whole groups, with one key having most rows."""
    import random

    rng = random.Random(4)
    rows = [(1 if k % 10 else 2, rng.uniform(0, 9000), rng.uniform(0, 60), float(rng.randrange(50))) for k in range(800)]
    rows = [(u, a, a + n, o) for u, a, n, o in rows]
    df = spark.createDataFrame(rows, "u int, a double, b double, o double")
    mine = lambda u: [(a, b, o) for k, a, b, o in rows if k == u]
    for width in (7.0, 1e6):
        got = sorted((r.u, r.a, r.b, r.o) for r in folds.merge_pieces(df, ["u"], "a", "b", "o", width=width).collect())
        assert got == sorted((u, *r) for u in (1, 2) for r in folds.merged(mine(u), 30))
        ints = df.withColumn("n", F.col("o").cast("int"))
        got = sorted((r.u, r.a, r.b, r.n) for r in folds.trim_overlaps(ints, ["u"], "a", "b", "n", width=width).collect())
        assert got == sorted((u, *r) for u in (1, 2) for r in folds.trimmed([(a, b, int(o)) for a, b, o in mine(u)]))
    for reach in (5.0, 600.0):
        got = {(r.u, r.a): r.group for r in folds.group_by_offset(df, ["u"], "a", "o", reach=reach).collect()}
        for u in (1, 2):
            own = sorted((a, o) for a, _, o in mine(u))
            want = folds.offset_groups(own, reach, 8)
            first = lambda gs: [gs.index(g) for g in gs]
            assert first([got[u, a] for a, _ in own]) == first(want)


def test_text_hash_of_any_text(spark):
    def want(t):
        h = 5381
        for k in range(0, len(t.encode("utf-16-be")), 2):
            h = (h * 33 + int.from_bytes(t.encode("utf-16-be")[k : k + 2], "big")) % 2**32
        out = ""
        while h:
            out, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out, h // 36
        return out

    texts = ["", "abc", "é ü", "🙂", "long " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.h for r in df.select("t", text.text_hash(F.col("t")).alias("h")).collect()} == {t: want(t) for t in texts}


def test_fuzzy_band_against_all_pairs(spark):
    from difflib import SequenceMatcher

    from sparkloom.plans import texts as plans

    rows = [(c, t, s) for c in range(12) for t, s in enumerate(["abcdef"[c % 5 :] + "x" * (c % 3), "q" * (c % 4) + "zz"][: 1 + c % 2])]
    have = {(r.conv_id, r.turn): (r.other, r.ratio) for r in plans.best_in_band(spark.createDataFrame(rows, "conv_id int, turn int, s string")).collect()}
    for c, t, s in rows:
        near = [(round(SequenceMatcher(None, s, x).ratio(), 6), -o, o) for o, u, x in rows if u == t and o != c and abs(o - c) <= 4]
        assert have[c, t] == (max(near)[2], max(near)[0])


def test_scan_twins(spark):
    from sparkloom.functions import labels

    df = spark.createDataFrame([("Ckay", "okay"), ("Fete", "Pete"), ("same", "same"), ("abc", "abcd"), ("cat", "dog")], "a string, b string")
    assert [r[0] for r in df.select(labels.scan_twins(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]


VOCABULARY = {"staging": 30, "stating": 2, "charlie": 200, "roger": 900, "complete": 40, "midcourse": 5, "caution": 9, "satisfactory": 4, "read": 5, "reed": 4, "how": 50, "do": 9, "you": 90, "latitude": 2, "longitude": 2}


def test_misread_words(spark):
    from sparkloom.operators import repair

    vocabulary = spark.createDataFrame(list(VOCABULARY.items()), "word string, n long")
    sound = ["latitude/longitude", "P76's", "TEI-4", "p.m", "1/250th", "21st", "don't", "you", "SEPs", "McGhee", "SPS/G&N", "DELTA-V", "", "1234", "Rogers"]
    bad = {
        "midcou_rse": "midcourse", "cau_tion": "caution", "Sta6ing": "staging", "Cha_lie": "charlie", "Ro6er": "roger", "ccmplete": "complete", "cornplete": "complete",
        "andsatisfactory": "and satisfactory", "Roger_": None, "re_d": None, "Orl,Hi": None, "e'aable": None, "zone": None, "_" * 9 + "a": None,
    }
    cores = spark.createDataFrame([(w,) for w in [*sound, *bad]], "core string")
    assert {r.core for r in repair.suspects(cores, vocabulary).collect()} == set(bad)
    only = cores.where(F.col("core").isin(list(bad)))
    assert {r.core: r.mend for r in repair.mends(only, vocabulary).collect()} == {k: v for k, v in bad.items() if v}
    assert repair.mends(only.limit(0), vocabulary).count() == 0 and repair.mends(only, vocabulary.limit(0)).count() == 0


def test_mended_texts(spark):
    from sparkloom.operators import repair

    vocabulary = spark.createDataFrame(list(VOCABULARY.items()), "word string, n long")
    pairs = spark.createDataFrame([("you", "read", 3)], "first string, second string, n long")
    rows = [(1, 'Okay, (Ro6er.  How do you re_d "Cha_lie"?', "x"), (2, None, "x"), (3, "", "x"), (4, "how  do you", "x"), (None, "Ro6er", "x"), (5, "Ro6er", "x"), (5, "Sta6ing", "x"), (6, "you Ro6er " * 3000, "x")]
    df = spark.createDataFrame(rows, "id long, t string, core string")
    plain = sorted(tuple(r) for r in repair.mended(df, ["id"], "t", vocabulary).where("id is not null and t is not null").collect())
    assert plain == [(1, 'Okay, (Ro6er.  How do you re_d "Cha_lie"?', "x", 'Okay, (Roger. How do you re_d "Charlie"?'), (3, "", "x", ""), (4, "how  do you", "x", "how  do you"), (5, "Ro6er", "x", "Roger"), (5, "Sta6ing", "x", "Staging"), (6, "you Ro6er " * 3000, "x", " ".join(["you Roger"] * 3000))]
    near = repair.mended(df, ["id"], "t", vocabulary, pairs)
    assert [r.mended for r in near.where("id = 1").collect()] == ['Okay, (Roger. How do you read "Charlie"?']
    assert [r.mended for r in near.where("id is null or id = 2").orderBy(F.desc("id")).collect()] == [None, "Ro6er"]


def test_suggested_and_rebuilt():
    from sparkloom.operators import repair

    line = [{"lead": "", "core": c, "trail": t} for c, t in (("Go", ""), ("Hous7on", ","), ("vesicular", ""), ("zonnes", "."))]
    assert repair.suggested(line, [False, True, False, True], ["go", "houston", "vesicular", "zones"], [True] * 4) == [None, "Houston,", None, "zones."]
    assert repair.suggested(line, [False, True, False, True], ["go", "houston", "vesicular", "zones"], [True, False, True, False]) == [None] * 4
    assert repair.suggested(line, [True] * 4, [], []) == [None] * 4 and repair.suggested([], [], ["a"], [True]) == []
    words = ["we", "c0py", "th_t", "now", "jack"]
    assert repair.rebuilt(words, [False, True, True, False, False], ["we", "copy", "that", "now,", "Jack."]) == "We copy that now, Jack."
    assert repair.rebuilt(words, [False, True, False, False, False], words) is None
    assert repair.rebuilt(words, [False, True, True, False, False], ["no", "word", "here", "is", "so"]) is None
    assert repair.rebuilt(words, [False, True, True, False, False], ["we"]) is None


SAID = "we are at station two|okay copy that|there is a big boulder here with white clasts|okay that is good|i will get a sample of the white clast|bag four seven six|copy four seven six|now the gray matrix|okay that is good|that one is in bag four seven seven|and the soil beside it|we are moving on now"


def test_lines_timed_by_speech(spark):
    from sparkloom.operators import timing

    lines = [x.split() for x in SAID.split("|")]
    starts = [1010 + 0.5 * sum(map(len, lines[:k])) for k in range(len(lines))]
    words = spark.createDataFrame([("t", 1010 + 0.5 * j, 1010.4 + 0.5 * j, j, w) for j, w in enumerate(w for line in lines for w in line)], "tape string, g double, end double, seq int, token string")
    ends = (0, len(lines) - 1)
    df = spark.createDataFrame([("t", k, starts[k] if k in ends else None, k in ends, x) for k, x in enumerate(lines)], "tape string, k int, at double, timed boolean, tokens array<string>")
    run = lambda d, w=words: {r.k: (r["at"], r.how) for r in timing.timed_by_speech(d, w, ["tape"], "k", "at", "timed", "tokens").collect()}
    got = run(df)
    assert all(abs(got[k][0] - starts[k]) <= 1 and got[k][1] == (None if k in ends else "found") for k in got) and len(got) == len(lines)
    few = run(df.where("k in (0, 1, 2, 3, 11)"))  # a short run: in turn
    assert all(abs(few[k][0] - starts[k]) <= 1 for k in few)
    assert run(df.where("k = 1"))[1][1] == "kept" and run(df, words.limit(0))[5] == (1010.0, "kept")


def test_place_of_a_line_not_found():
    from sparkloom.operators import timing

    words = [(0.0, 0.4, "one"), (0.5, 0.9, "two"), (1.0, 1.4, "three"), (5.0, 5.4, "four"), (5.5, 5.9, "five")]
    assert timing.loosely(["four", "five", "x"], ["one", "two", "three"], 0.0, 60.0, words) == (4.8, "loose")
    assert timing.loosely(["x"], ["one", "two", "three"], 0.0, 60.0, words) == (4.8, "speech")
    assert timing.loosely(["x"], ["one", "two", "three"], 0.0, 60.0, words[:3]) == (1.9, "after")
    assert timing.loosely(["x"], ["one"], 0.0, 1.0, words[:3]) == (0.7, "after")
    assert timing.loosely(["x"], ["one"], 0.0, 1.0, []) == (0.0, "kept")
    assert [h for _, h in timing.timed_run([], [["x"], ["y"]], 0.0, 60.0, words)] == ["speech", "after"]
