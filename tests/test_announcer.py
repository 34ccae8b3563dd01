"""Announcements grown around cues, against the walk along a whole tape and by cases of each rule."""

import random

import pandas as pd
import pytest

from sparkloom.operators import announcer

R = announcer.Rules()
LABELS = ["capcom", "cc"]
CREW = ["burn complete and we have", "reading you loud and clear", "we are go for the next pass"]
TALK = ["the", "crew", "is", "resting", "now", "flight", "director", "says", "all", "well.", "Dr.", "capcom", "roger", "over."]


def tape(seed, seconds=9000):
    rng, t, words, lines = random.Random(seed), 0.0, [], []
    while t < seconds:
        kind = rng.random()
        if kind < 0.08:
            said = "This is Apollo Control at 5 hours"
        elif kind < 0.12:
            said = "mission control"
        elif kind < 0.35:
            said = rng.choice(CREW)
            lines.append((round(t + rng.choice([0, 0, -3, 40]), 2), said.split(), rng.random() < 0.6))
        else:
            said = " ".join(rng.choice(TALK) for _ in range(rng.randrange(1, 14)))
        for w in said.split():
            words.append((round(t, 2), round(t + 0.3, 2), w))
            t += rng.choice([0.32, 0.4, 0.9, 1.7])
        t += rng.choice([0.5, 2, 3.5, 5, 9.5, 30] if rng.random() < 0.9 else [700, 1500])
    return words, sorted(lines)


def whole(words, lines, a, z):
    """The same walk over a segment as one tape, with the crew's words by plain loops."""
    low = lambda w: "".join(c for c in w.lower() if c.isalpha())
    crew = [False] * len(words)
    for k in range(len(words) - 2):
        gram = [low(w) for _, _, w in words[k : k + 3]]
        if any(abs(t - words[k][0]) < 300 and gram == ws[j : j + 3] for t, ws, _ in lines for j in range(len(ws) - 2)):
            crew[k : k + 3] = [True] * 3
    keep = [k for k, w in enumerate(words) if a <= w[0] <= z]
    rows = []
    for k in keep:
        b = low(words[k][2])
        cue = 0 < k < len(words) - 1 and b in ("apollo", "mission") and low(words[k + 1][2]) == "control" and low(words[k - 1][2]) in ("is", "this")
        rows.append((words[k][0], words[k][1], b, crew[k] or b in announcer.RADIO or words[k][2] == "over.", cue))
    p = pd.DataFrame(rows, columns=["start", "end", "bare", "crew", "cue"])
    q = pd.DataFrame([(t, len(ws), h) for t, ws, h in lines], columns=["t", "n", "heard"])
    t = announcer.Tape(p, q, a, z, set(LABELS), R)
    mine = [words[k] for k in keep]
    own = lambda i, j: [w for w, label in zip(mine[i:j], t.label[i:j]) if not label]
    return [(x["t0"], x["t1"], x["over_to"], own(x["first"], x["last"] + 1), own(x["last"] + 1, x["over"] + 1) if x["over"] is not None else []) for x in t.announcements()]


def test_chains_of_cues_as_one_walk(spark):
    tapes = {f"t{k}": tape(k) for k in range(5)}
    segments = [(k, a, z) for k in tapes for a, z in ((0.0, 4000.0), (4000.5, 9000.0))]
    w = spark.createDataFrame([(k, *x) for k, (ws, _) in tapes.items() for x in ws] + [("t0", None, 1.0, "x"), ("t0", 3.0, 3.1, None)], "tape string, start double, end double, token string").repartition(6)
    l = spark.createDataFrame([(k, *x) for k, (_, ls) in tapes.items() for x in ls], "tape string, t double, tokens array<string>, heard boolean").repartition(3)
    s = spark.createDataFrame(segments, "tape string, from double, to double")
    got = {}
    for r in announcer.announcements(w, l, s, LABELS).collect():
        got.setdefault((r["tape"], r["from"]), []).append((r["t0"], r["t1"], r["over_to"], [tuple(x) for x in r["words"]], [tuple(x) for x in r["over_words"]]))
    want = {(k, a): x for k, a, z in segments if (x := whole(*tapes[k], a, z))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(map(len, want.values())) > 20 and any(x[2] for v in want.values() for x in v)


def placed(*parts):
    """(start, text) pairs as words half a second apart."""
    return [(t + 0.5 * k, t + 0.5 * k + 0.3, w) for t, text in parts for k, w in enumerate(text.split())]


def spans(words, lines=()):
    return [(x[0], " ".join(w for *_, w in x[3]), " ".join(w for *_, w in x[4])) for x in whole(words, sorted(lines), 0.0, 1e5)]


def test_growth_by_pauses_crew_and_lines():
    cue = "This is Apollo Control at five hours."
    assert spans(placed((100, cue), (106.0, "All is well."))) == [(99.7, f"{cue} All is well.", "")]
    assert spans(placed((100, cue), (109.0, "The next figure is ten."))) == [(99.7, f"{cue} The next figure is ten.", "")]  # a pause for reading
    assert spans(placed((100, cue), (109.0, "Well well."))) == [(99.7, cue, "")]  # too little after it
    assert spans(placed((100, cue), (109.0, "Roger that is all fine."))) == [(99.7, cue, "")]  # radio talk
    line = (97.5, "we are go for it".split(), True)
    assert spans(placed((97.5, "we are go for it"), (102.5, cue)), [line])[0][1] == cue  # the crew's line before
    assert spans(placed((97.5, "the crew now rests. And"), (102.5, cue)))[0][1] == f"the crew now rests. And {cue}"
    assert spans(placed((100, cue), (104.0, "capcom go on")))[0][1] == cue  # a label is a change of voice
    over = spans(placed((100, cue), (104.0, "Flight says that all is well here and they rest")), [(105.0, "nobody can make this out".split(), False)])
    assert over == [(99.7, f"{cue} Flight", "says that all is well here and they rest")]
    heard = spans(placed((100, cue), (104.0, "Flight says that all is well here and they rest")), [(105.0, "they can make this out".split(), True)])
    assert heard[0][2] == "" and heard[0][1].startswith(cue)


def cut_texts(text, pause_before=(), rate=1.0):
    t, words = 0.0, []
    for k, w in enumerate(text.split()):
        t += 20.0 if k in pause_before else 0.5
        words.append({"start": t, "end": t + 0.3, "token": w})
    edges = [0, *announcer.cuts(words, rate), len(words)]
    return [" ".join(w["token"] for w in words[a:z]) for a, z in zip(edges, edges[1:])]


def test_announcements_are_parted_where_times_do_not_follow():
    one, two = "This is Apollo Control at 65 hours, 5 minutes. The crew rests.", "This is Apollo Control at 66 hours, 5 minutes. All is well."
    assert cut_texts(f"{one} {two}") == [one, two]
    assert cut_texts(one) == [one] and cut_texts("") == [""]
    same = "This is Apollo Control at 65 hours, 6 minutes. Still resting."
    assert cut_texts(f"{one} {same}") == [f"{one} {same}"]
    off, end = "At 65 hours, 5 minutes, this is Apollo Control.", "Nothing new. At 66 hours, 5 minutes, this is Apollo Control."
    assert cut_texts(f"{off} {end}") == [off, end]
    named = "The crew rests. This is Apollo Control. Nothing new. At 66 hours, 9 minutes, this is Mission Control."
    first = "This is Apollo Control at 65 hours, 5 minutes."
    assert cut_texts(f"{first} {named}") == [f"{first} The crew rests.", named.removeprefix("The crew rests. ")]
    plain = f"{first} The crew rests. Nothing new. At 66 hours, 9 minutes, this is Mission Control."
    assert cut_texts(plain, pause_before=(12,)) == [f"{first} The crew rests.", "Nothing new. At 66 hours, 9 minutes, this is Mission Control."]


def test_parts_rejoin_to_the_whole(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        text = " ".join(rng.choice(["This is Apollo Control at 65 hours.", "This is Apollo Control at 70 hours, 2 minutes.", "All is well.", "At 71 hours, 5 minutes, this is Apollo Control.", "Dr. Paine rests."]) for _ in range(rng.randrange(0, 9)))
        words = [(0.5 * j, 0.5 * j + 0.3, w) for j, w in enumerate(text.split())]
        rows.append((k, 0.0, 0.5 * len(words), None, words, [(99.0, 99.5, "x")], 1.0))
    df = spark.createDataFrame(rows, f"tape int, {announcer.ANNOUNCEMENT.replace('over_to double, words', 'over_to double, words')}, rate double")
    got = {}
    for r in announcer.parted(df).collect():
        got.setdefault(r["tape"], []).append(r)
    for k, row in enumerate(rows):
        parts = sorted(got[k], key=lambda r: r["t0"])
        assert [tuple(w) for p in parts for w in p["words"]] == row[4]
        assert [len(p["over_words"]) for p in parts] == [0] * (len(parts) - 1) + [1]
    assert any(len(p) > 2 for p in got.values())


def test_announcements_move_to_the_time_that_they_give(spark):
    segments = [("m", "a", 0.0, 1000.0, 5000.0, 1.0), ("m", "b", 0.0, 100.0, 9000.0, 1.0)]
    found = [
        ("m", "a", 100.0, 130.0, 5085.0, True),  # in its time
        ("m", "a", 300.0, 340.0, 7000.0, True),  # moved
        ("m", "a", 500.0, 520.0, 7000.0, True),  # the same minute: behind it
        ("m", "a", 700.0, 710.0, 9030.0, False),  # another tape plays there
        ("m", "b", 50.0, 60.0, 99999.0, True),  # too far
        ("m", "b", 70.0, 80.0, None, None),
        ("n", "z", 1.0, 2.0, 3.0, True),  # no segment
    ]
    f = spark.createDataFrame(found, "mission string, tape string, t0 double, t1 double, said double, opens boolean")
    s = spark.createDataFrame(segments, "mission string, tape string, from double, to double, get double, rate double")
    own, parts = announcer.moved(f, s, ["mission"])
    get = {(r["tape"], r["t0"]): r["get"] for r in own.collect()}
    assert get == {("a", 100.0): 5100.0, ("a", 300.0): 7020.0, ("a", 500.0): 7061.0, ("a", 700.0): 5700.0, ("b", 50.0): 9050.0, ("b", 70.0): 9070.0, ("z", 1.0): None}
    rows = sorted((r["tape"], r["from"], r["to"], r["get"], r["spoken"]) for r in parts.collect())
    assert rows == [("a", 0.0, 300.0, 5000.0, False), ("a", 300.0, 340.0, 7020.0, True), ("a", 340.0, 500.0, 5340.0, False), ("a", 500.0, 520.0, 7061.0, True), ("a", 520.0, 700.0, 5520.0, False), ("a", 700.0, 710.0, 5700.0, False), ("a", 710.0, 1000.0, 5710.0, False), ("b", 0.0, 100.0, 9000.0, False)]
    assert sum(r[2] - r[1] for r in rows if r[0] == "a") == pytest.approx(1000)
