"""Rows of scraps, notes in rows and texts, spoken times and counts against plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import notes
from sparkloom.operators import counts, rewrite, scraps, transcripts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_rows_of_scraps(spark):
    words = spark.createDataFrame([(w,) for w in ("the", "We", "go", "copy", "on")], "word string")
    junk = ["bee oy", "2oY eeo", "", None, "o ek ae", "eee"]
    kept = ["Ahh!", "P64", "- -", "go on", "52", "_0TRAL x", "I", "the's", "RCS", "Bob ee", "x/gos"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(junk + kept)], "id int, t string")
    got = {r["id"]: r["scraps"] for r in scraps.with_scraps(df, "id", "t", words).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(junk) + [False] * len(kept)
    folds = ["TE EE ET I a _ aeennn", "ORT TT nee"]
    rest = ["the we go", "ORT TT 3 nee", "Go. TT nee ort", "TT nee", "we copy tt ee nn oo", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(folds + rest)], "id int, t string")
    got = {r["id"]: r["fold"] for r in scraps.with_fold(df, "id", "t", words).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(folds) + [False] * len(rest)


def test_headings(spark):
    lines = ["gets stopped. Tap'e 69/5", "target load I Tape 52/6 and your set", "Okay. Page 762", "plain line", "12. i Tape h/2 [ D", "go Page 12 Tape 5/3", None]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert [r[0] for r in df.select(scraps.without_headings(F.col("t"))).collect()] == ["gets stopped.", "target load and your set", "Okay.", "plain line", "12.", "go", None]


NOTE = ["COMMUNICATIONS", "LINK", "IN", "USE", "BETWEEN", "CC", "AND", "CM"]


def plain_note(words):
    def alike(read, word):
        read = re.sub("[^A-Za-z]", "", read or "")
        return bool(read) and sum(c.isupper() for c in read) >= 0.6 * len(read) and (read.upper() == word or len(word) >= 5 and distance(read.upper(), word) <= 2)

    kept, k = [], 0
    for w in words:
        if k < len(NOTE) and alike(w, NOTE[k]):
            k += 1
        else:
            kept.append(w)
    if k == len(NOTE):
        return kept, True
    n = sum(any(alike(w, p) for p in NOTE) for w in words)
    return ([], True) if n >= 6 and len(words) <= n + 2 else (words, False)


def test_notes_are_taken_out_as_by_plain_distances(spark):
    rng = random.Random(4)

    def damaged(w):
        out = list(w)
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(out)) if out else 0
            out[k : k + 1] = rng.choice([[], [rng.choice("ABCX_3")], [*out[k : k + 1], "Q"], [c.lower() for c in out[k : k + 1]]])
        return "".join(out)

    rows = []
    for _ in range(300):
        own = [damaged(w) if rng.random() < 0.5 else w for w in NOTE]
        if rng.random() < 0.2:
            rng.shuffle(own)
        if rng.random() < 0.2:
            own.pop(rng.randrange(len(own)))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            own.insert(rng.randrange(len(own) + 1), rng.choice(["roger", "IN", "go", "LINK", "52"]))
        rows.append(own)
    df = spark.createDataFrame([(k, r) for k, r in enumerate([*rows, [], None, ["COMMUNICATIONS", None]])], "k int, w array<string>")
    got = {r["k"]: (r["x"]["words"], r["x"]["noted"]) for r in df.select("k", scraps.without_note(F.col("w"), NOTE).alias("x")).collect()}
    want = [plain_note(r) for r in rows] + [([], False), (None, False), (["COMMUNICATIONS", None], False)]
    assert [got[k] for k in range(len(want))] == want
    assert 60 < sum(noted for _, noted in want) < 290


RULES = [
    notes.Rule(r"\bP(\d\d)\b", r"Program \1", "A program.", family="alignment"),
    notes.Rule(r"\btorquing angles?\b", "Torquing", family="alignment", ignore_case=True),
    notes.Rule(r"\bfour balls\b", "Balls", family="alignment", weak=True, ignore_case=True),
    notes.Rule(r"\bangles?\b", "Angle"),
    notes.Rule(r"\b(V|Verb )(\d\d)\b", r"Verb \2", when="computer|V"),
    notes.Rule(r"\b\d+ feet\b", "Height", only="[1-9]00"),
    notes.Rule(r"\d*", "Nothing matches emptily"),
]
FAMILIES = [notes.Family("alignment", "Alignment", "All of it.")]


def plain_notes(text):
    found = []
    for r in RULES:
        for m in re.finditer(r.pattern, text, re.I if r.ignore_case else 0):
            if m.end() > m.start() and (not r.when or re.search(r.when, text)) and (not r.only or re.search(r.only, m[0])) and all(m.end() <= a or z <= m.start() for a, z, *_ in found):
                found.append((m.start(), m.end(), r, m))
    found.sort(key=lambda f: f[0])
    own = [f for f in found if f[2].family]
    if sum(not f[2].weak for f in own) >= 2:
        return [(a, z, "Alignment" if r.family else m.expand(r.title)) for a, z, r, m in found if not r.family or (a, z) == own[0][:2]]
    return [(a, z, m.expand(r.title)) for a, z, r, m in found]


def test_notes_on_terms(spark):
    rng = random.Random(2)
    terms = ["P52", "torquing angles", "Torquing Angle", "four balls", "angle", "V37", "Verb 06", "computer", "300 feet", "50 feet", "and", "Ünd"]
    texts = [" ".join(rng.choice(terms) for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = {r["k"]: [(n["from"], n["to"], n["title"]) for n in r["n"]] for r in df.select("k", notes.notes(F.col("t"), RULES, FAMILIES).alias("n")).collect()}
    assert [got[k] for k in range(len(got))] == [plain_notes(t) for t in texts] + [[]]
    assert sum("Alignment" in [t for *_, t in n] for n in got.values()) > 30


def test_announced_times():
    a = transcripts.announced_times
    assert a("This is Apollo Control at 59 hours, 9 minutes.") == [(8, 59 * 3600 + 540, "open")]
    assert a("Apollo Control, Houston, it's 66 hours one minute") == [(0, 66 * 3600 + 60, "open")]
    assert a("apollo control at 90 hours at 10 minutes now") == [(0, 90 * 3600 + 600, "open")]
    assert a("At 78 hours, 58 minutes into the flight, this is Apollo Control.")[0][1:] == (78 * 3600 + 58 * 60, "close")
    assert a("This is Apollo Control at one hundred and two hours. All is well.")[0][1:] == (102 * 3600, "open")
    assert a("At 67 hours, this is Apollo Control.")[0][1:] == (67 * 3600, "close")
    assert a("mission control here is showing a wake time 7 hours 22 minutes") == [] and a("Apollo Control at 400 hours") == [] and a(None) == [] and a("") == []
    two = a("This is Apollo Control at 65 hours, 5 minutes. Quiet. This is Apollo Control at 66 hours.")
    assert [s for _, s, _ in two] == [65 * 3600 + 300, 66 * 3600]


def test_said_times_between_other_words():
    assert transcripts.said_times("at 65 hours at 10 minutes") == [(234600, "words")]
    assert transcripts.said_times("some hours and 65 hours of 10 minutes, is 3 hours") == [(234600, "words"), (10800, "words")]
    assert transcripts.said_times("one hundred and two hours and forty-five minutes") == [(369900, "words")]


def plain_counts(words):
    """The phrases over the whole tape as one text."""
    number = {w: str(k) for w, k in transcripts.NUMBERS.items() if k <= 60}
    text, at = "", {}
    for t, w in words:
        at[len(text)] = t
        w = w.lower().strip(".,!?;:-")
        text += number.get(w, w) + " "
    out = []
    for m in re.finditer(counts.COUNTDOWN, text):
        n, u, a, v, s = m.groups()
        sec = lambda n, u: int(n) * (3600 if u[0] == "h" else 60 if u[0] == "m" else 1)
        g = int(n) if not u else sec(n, u) + (sec(a, v) if a else 0) + int(s or 0)
        if g <= (3600 if u else 60):
            full = not u or s or "second" in f"{u} {v}" or text[: m.start()].endswith("mark ")
            out.append((at[m.start()], -g, 1.0 if full else 0.5))
    for p, less in ((counts.INTO_FLIGHT, 0.5), (counts.MARK, 1.0)):
        for m in re.finditer(p, text):
            g = int(m[1]) * 60 + int(m[2] or 0)
            if g <= 3600:
                out.append((at[m.start()], g, 1.0 if m[2] else less))
    return sorted(out)


def test_counts_across_rows_and_tasks(spark):
    rng = random.Random(7)
    phrases = ["T minus 15", "T minus five minutes and counting", "mark T minus one minute", "t-minus 2 hours", "T minus 1 hour 5 minutes", "T minus 10 minutes 30 seconds", "at 6 minutes, 10 seconds into the flight",
               "mark, eight minutes", "mark 3 minutes 20 seconds", "2 minutes into the mission", "minutes into the day", "mark my words", "minus 5", "T minus 70", "Mark 5 minutes and 4 seconds into the flight.", "70 minutes into the flight", "T minus 3 minutes 2 minutes 9 seconds"]
    tapes = {}
    for k in range(12):
        words, t = [], 0.0
        for _ in range(40):
            for w in (rng.choice(phrases) if rng.random() < 0.6 else "and we go on").split():
                t = round(t + rng.choice([0.3, 0.4, 2.0]), 2)
                words.append((t, w))
        tapes[f"t{k}"] = words
    rows = [(k, t, n, w) for k, ws in tapes.items() for n, (t, w) in enumerate(ws)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [("t0", None, 1, "mark")], "tape string, t double, seq int, token string").repartition(7)
    got = {}
    for r in counts.anchors(df, ["tape"], width=20, step=15).collect():
        got.setdefault(r["tape"], []).append((r["t"], r["g"], r["weight"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_counts(ws) for k, ws in tapes.items()}
    assert sum(map(len, got.values())) > 150


def test_rewrites_in_order_with_look_ups(spark):
    known = {"broadcast", "roger", "we", "the", "all", "well", "hello", "come", "corner", "comer", "together", "to", "go"}
    cases = {
        "a broad- cast now": "a broadcast now",
        "a broad- sheet now": "a broad- sheet now",  # the whole is not known
        "R0ger , he110": "Roger, he110",  # 0 alone is mended; two steps would be needed for the other
        "he1lo": "hello",
        "l5 and 1I2": "15 and 112",
        "a  corne": "a come",
        "a corner": "a corner",  # known as it is
        "corne rn": "come rn",
        "cornes": "cornes",
        "to gether": "to gether",  # one half is known
        "tog ether": "together",
        "we the the well .": "we the well.",
        "‘go’ “all”": "'go' \"all\"",
        "": "",
    }
    rows = [(k, t) for k, t in enumerate(cases)] + [(99, None)]
    v = spark.createDataFrame([(w,) for w in known], "word string")
    got = {r["k"]: r["t"] for r in rewrite.rewritten(spark.createDataFrame(rows, "k int, t string"), "k", "t", rewrite.GENERAL, v).collect()}
    for k, (text, want) in enumerate(cases.items()):
        plain = text
        for phase in rewrite.phases(rewrite.GENERAL):
            plain = rewrite.run_phase(phase, plain, known.__contains__)
        assert got[k] == plain == want, text
    assert got[99] is None


def test_rewrites_as_plain_substitutions_on_random_texts(spark):
    rng = random.Random(3)
    known = {"".join(rng.choice("abo") for _ in range(rng.randrange(2, 5))) for _ in range(25)}
    texts = ["".join(rng.choice(["a", "b", "o", "0", " ", "- ", "ab", "bo"]) for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    rules = [rewrite.Rewrite("bb", "b"), rewrite.Mend(r"\b([a-z]+)- ([a-z]+)\b", r"\1\2", known=(r"\1\2",)), rewrite.Mend(r"\b[a-z0]*0[a-z0]*\b", r"\g<0>", known=(r"\g<0>",), unknown=("=",), swap=(("0", "o"),)), rewrite.Rewrite("aa+", "a")]

    def plain(t):
        t = t.replace("bb", "b")
        t = re.sub(r"\b([a-z]+)- ([a-z]+)\b", lambda m: m[1] + m[2] if m[1] + m[2] in known else m[0], t)
        t = re.sub(r"\b[a-z0]*0[a-z0]*\b", lambda m: m[0].replace("0", "o") if m[0].replace("0", "o") in known and m[0] not in known else m[0], t)
        return re.sub("aa+", "a", t)

    v = spark.createDataFrame([(w,) for w in known], "word string")
    out = rewrite.rewritten(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", rules, v)
    assert {r["k"]: r["t"] for r in out.collect()} == {k: plain(t) for k, t in enumerate(texts)}


def test_places_of_keys(spark):
    of = transcripts.span_of
    assert of("We go, now.", "GO NOW") == (3, 10) and of("We go, now .", "go now.") == (3, 12) and of("say (go) now", "(go)") == (4, 8)
    text = "We are comintl up on the ridge and stop"
    assert of(text, "coming up on the ridge") == (7, 30) and of(text, "coming") is None
    assert of(text, "nobody said these words here") is None and of(None, "x") is None and of("x", None) is None and of("", "a") is None and of("abc", "...") is None
    spread = "coming " + "x" * 40 + " up on the ridge"
    assert of(spread, "coming up on the ridge") is None
    df = spark.createDataFrame([("We go, now.", "go now"), (None, "x"), ("abc", "zz")], "t string, k string").select(transcripts.span_udf("t", "k").alias("s"))
    assert [(r["s"]["from"], r["s"]["to"]) for r in df.collect()] == [(3, 10), (None, None), (None, None)]


def test_headings_and_abbreviations(spark):
    from sparkloom.functions import text

    df = spark.createDataFrame([("Tape 80B/1",), (" tape lA/2",), ("Tape 80C/1",), ("Tape AB/1",), ("the tape 8B",), ("Tape B",), (None,)], "t string")
    assert [r[0] for r in df.select(text.side_of_heading(F.col("t"))).collect()] == ["B", "A", None, None, None, None, None]
    words = spark.createDataFrame([("Rog.",), ("Roger,",), ("x-9",), (None,)], "t string")
    assert [r[0] for r in words.select(text.normalised(F.col("t"), {"rog.": "roger"})).collect()] == ["roger", "roger", "x9", None]


def test_null_cells_of_repairs(spark):
    from sparkloom.operators import repair

    word = "struct<lead:string,core:string,trail:string>"
    rows = [([("", "Hou_ton", ",")], [True], ["houston"], [True]), (None, [True], ["a"], [True]), ([("", "a", "")], None, ["a"], [True]), ([("", "a", "")], [True], None, None)]
    df = spark.createDataFrame(rows, f"w array<{word}>, d array<boolean>, h array<string>, k array<boolean>")
    assert [r[0] for r in df.select(repair.suggested_udf("w", "d", "h", "k")).collect()] == [["Houston,"], None, [None], [None]]
    lines = [(["we", "c_py", "th_t"], [False, True, True], ["we", "copy", "that"]), (None, [True], ["a"]), (["a"], None, ["a"]), (["a"], [True], None)]
    df = spark.createDataFrame(lines, "w array<string>, d array<boolean>, h array<string>")
    assert [r[0] for r in df.select(repair.rebuilt_udf("w", "d", "h")).collect()] == ["We copy that", None, None, None]


def test_words_of_many_marks_are_mended_as_well(spark):
    """However many characters of a word may be misread, each is tried; only who asks for a limit has one."""
    from sparkloom.operators import repair

    long = "ba" * 600 + "q"
    vocabulary = spark.createDataFrame([("recollections", 5), ("reconciliations", 4), (long, 3), ("roger", 9)], "word string, n long")
    cores = spark.createDataFrame([("recollecti0ns",), ("reconcili@tions",), (f"8{long[1:]}",), ("Ro6er",), ("8" + "a" * 5000,)], "core string")
    assert {r.core: r.mend for r in repair.mends(cores, vocabulary).collect()} == {"recollecti0ns": "recollections", f"8{long[1:]}": long, "Ro6er": "roger"}
    assert {r.core for r in repair.mends(cores, vocabulary, repair.MOST_SPOTS).collect()} == {f"8{long[1:]}", "Ro6er"}
    texts = spark.createDataFrame([(1, "Ro6er, recollecti0ns.")], "id int, t string")
    assert [r.mended for r in repair.mended(texts, ["id"], "t", vocabulary).collect()] == ["Roger, recollections."]
