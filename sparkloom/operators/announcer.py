"""Announcements on tapes: found by a cue phrase, grown over pauses, parted by the times they give, moved to
those times, and read as sentences.

An announcement holds a cue ("this is ... control") and is at most ten minutes long on either side of it.
So cues within reach of each other are chained, and a task grows the announcements of one chain from the
words around it; no tape is read as a whole. Which words are the crew's (three in a row as a line near
there has them) is a join of word triples in time bands. What a chain finds is a row for each
announcement; moving them works on these rows alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .joins import band_join, cogrouped, interval_join
from .sequence import clusters, numbered
from .transcripts import announced_times

#: Words of the cue, of radio talk, and of speakers' labels; a sentence's end and what looks like it.
CUE_OF, CUE_WORD, CUE_AFTER = ("apollo", "mission"), "control", ("is", "this")
RADIO = ["roger", "copy", "okay", "ok", "affirmative", "negative", "wilco", "readback"]
TITLE = r"^(?:Dr|Mr|Mrs|Ms|St|Jr|Sr|Gen|Col|Lt|Capt|Gov|Sen|Rep|vs|[B-HJ-Z])\.$"


@dataclass(frozen=True)
class Rules:
    breath: float = 1.5  #: pauses within the cue's own sentence
    pause: float = 4.0  #: pauses within an announcement
    near: float = 8.0  #: of the cue, where only the pause counts
    long: float = 600.0  #: an announcement lasts no longer
    reading: float = 10.0  #: a pause for the next figure
    more: int = 4  #: words that go on after it
    lead: float = 0.3
    slack: float = 0.5
    per_word: float = 0.35
    soon: float = 2.0  #: lines so soon after the start do not end it
    over_words: int = 3
    over_seconds: float = 3.0
    nearby: float = 300.0  #: a line is said so near its time
    out_of_step: float = 240.0
    opens_after: float = 20.0  #: from the start of an announcement to the time that it opens with
    closes_before: float = 40.0  #: from the time that it closes with to its end
    early: float = 90.0  #: an announcement so much before, or
    late: float = 150.0  #: after its time stays
    far: float = 12 * 3600.0
    hops: int = 6


def bare(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z]", "")


class Tape:
    """Words around a chain of cues, and the lines there."""

    def __init__(self, words: pd.DataFrame, lines: pd.DataFrame, low: float, high: float, labels: set[str], rules: Rules):
        self.start, self.end, self.said = words["start"].tolist(), words["end"].tolist(), words["bare"].tolist()
        self.crew, self.cue = words["crew"].tolist(), words["cue"].tolist()
        self.low, self.high, self.r = low, high, rules
        self.label = [w in labels for w in self.said]
        self.line, self.length = lines["t"].tolist(), lines["n"].tolist()
        self.heard = sorted(lines.loc[lines["heard"], "t"])

    def gap(self, k: int) -> float:
        return self.start[k + 1] - self.end[k]

    def first(self, cue: int, floor: int) -> int:
        """Back from the cue: over breaths close to it, else over pauses, past no line and no word of the crew's."""
        r, k = self.r, bisect_left(self.line, self.start[cue] - self.r.slack) - 1
        spoken = self.line[k] + r.slack + r.per_word * self.length[k] if k >= 0 else -1
        a = cue
        while a > floor:
            before, far = a - 1, self.start[cue] - self.start[a - 1]
            close = self.gap(before) < r.breath and far < r.near
            his = self.gap(before) < r.pause and far < r.long and self.start[before] > spoken and not self.crew[before]
            if self.label[before] or not (close or his):
                break
            a = before
        return a

    def run(self, k: int, until: float, labels: bool = True, start: float | None = None) -> int:
        """On over pauses from word k, while words start before `until` (and within the longest time)."""
        while k + 1 < len(self.start) and self.gap(k) < self.r.pause and self.start[k + 1] < until:
            if labels and self.label[k + 1] or start is not None and self.start[k + 1] - start >= self.r.long:
                break
            k += 1
        return k

    def last(self, cue: int, start: float, until: float) -> int:
        """On from the cue, and past a pause for reading where what follows is more of the same."""
        r, b = self.r, cue
        while True:
            b = self.run(b, until, True, start)
            if not (b + 1 < len(self.start) and self.gap(b) < r.reading and self.start[b + 1] < until):
                return b
            end = self.run(b + 1, until, labels=False)
            own = range(b + 1, end + 1)
            if len(own) < r.more or self.start[end] - start >= r.long or any(self.crew[k] or self.label[k] for k in own):
                return b
            b = end

    def carried_on(self, b: int, start: float) -> int:
        """On from the end, over lines that nobody can make out, up to the next line that is heard."""
        k = bisect_right(self.heard, self.end[b])
        stop = self.heard[k] - self.r.slack if k < len(self.heard) else float("inf")
        return self.run(b, stop, True, start)

    def announcements(self) -> list[dict]:
        r, out, floor, i = self.r, [], 0, 0
        while i < len(self.start):
            if not self.cue[i]:
                i += 1
                continue
            a = self.first(i, floor)
            t0 = max(self.start[a] - r.lead, self.low)
            k = bisect_right(self.line, t0 + r.soon)
            following = self.line[k] if k < len(self.line) else None
            b = self.last(i, t0, float("inf") if following is None else following - r.slack)
            c = self.carried_on(b, t0)
            covers = following is not None and c - b >= r.over_words and self.end[c] - max(following, self.end[b]) >= r.over_seconds
            tail = b if covers else c
            t1 = min(self.end[b] + r.lead, self.high)
            out.append({"t0": t0, "t1": t1, "first": a, "last": tail, "over": c if covers else None, "over_to": min(self.end[c] + r.lead, self.high) if covers else None})
            i = floor = max(c if covers else b, tail) + 1
        return out


def _marked(words: DataFrame, lines: DataFrame, labels: list[str], rules: Rules) -> DataFrame:
    """Words with their number on the tape, bare form, whether they are the crew's, and cues."""
    w = words.where("start is not null and end is not null and token is not null")
    w = stored(numbered(w.select("tape", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "token", bare(F.col("token")).alias("bare"), F.regexp_replace(F.lower("token"), "[^a-z0-9]", "").alias("_x")), ["tape"], "start", ["end", "token"], 600, "n"), "words")
    line = Window.partitionBy("tape").orderBy("n")
    x = [F.col("_x"), F.lead("_x", 1).over(line), F.lead("_x", 2).over(line)]
    full = (x[0] != "") & (x[1] != "") & (x[2] != "")
    grams = w.select("tape", "n", F.col("start").alias("_at"), F.when(full, F.concat_ws(" ", *x)).alias("gram")).where("gram is not null")
    three = F.transform(F.sequence(F.lit(1), F.size("tokens") - 2), lambda k: F.array_join(F.slice("tokens", k, 3), " "))
    said = lines.where(F.size("tokens") >= 3).select("tape", F.col("t").alias("_t"), F.explode(three).alias("gram")).distinct()
    close = band_join(grams, said, ["tape", "gram"], "_at", "_t", rules.nearby, rules.nearby).where(F.abs(F.col("_at") - F.col("_t")) < rules.nearby)
    crew = close.select("tape", F.explode(F.array(F.col("n"), F.col("n") + 1, F.col("n") + 2)).alias("n")).distinct().withColumn("_own", F.lit(True))
    radio = F.col("bare").isin(RADIO) | F.trim(F.lower("token")).rlike(r"^over[.?!]$")
    before, after = F.lag("bare").over(line), F.lead("bare").over(line)
    cue = F.coalesce(F.col("bare").isin(*CUE_OF) & (after == CUE_WORD) & before.isin(*CUE_AFTER), F.lit(False))
    return w.withColumn("cue", cue).join(crew, ["tape", "n"], "left").withColumn("crew", F.coalesce("_own", F.lit(False)) | radio).drop("_own", "_x")


ANNOUNCEMENT = "t0 double, t1 double, over_to double, words array<struct<start:double,end:double,token:string>>, over_words array<struct<start:double,end:double,token:string>>"


def announcements(words: DataFrame, lines: DataFrame, segments: DataFrame, labels: list[str] = (), rules: Rules = Rules()) -> DataFrame:
    """words: tape, start, end, token; lines: tape, t, tokens (in small letters), heard (can be made out);
    segments: tape, from, to (not overlapping). For each announcement tape, from (of its segment), t0, t1,
    words, and, where it goes on over lines that nobody can make out, over_to and over_words."""
    marked = stored(_marked(words, lines, list(labels), rules), "marked")
    s = segments.select("tape", F.col("from").cast("double").alias("from"), F.col("to").cast("double").alias("to"), (F.col("to") + 1e-6).cast("double").alias("_till"))
    inside = stored(interval_join(marked, s, ["tape"], "start", "from", "_till", 600).drop("_till"), "inside")
    reach, back = rules.long + 20, rules.long + 10
    cues = inside.where("cue").select("tape", "from", "to", (F.col("start") - back).alias("_a"), (F.col("start") + reach).alias("_z"))
    chains = clusters(cues, ["tape", "from"], "_a", F.col("_z"), 2 * reach, "_chain").groupBy("tape", "from", "to", "_chain").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    chains = stored(chains, "chains")
    near = interval_join(inside, chains.drop("to"), ["tape", "from"], "start", "_a", "_z", reach).select("tape", "from", "_chain", "n", "start", "end", "token", "bare", "crew", "cue", "to")
    l = lines.select("tape", F.col("t").cast("double").alias("t"), F.size("tokens").alias("n"), F.coalesce("heard", F.lit(False)).alias("heard")).where("t is not null")
    around = interval_join(l, chains.select("tape", "from", "_chain", (F.col("_a") - 1000).alias("_a"), (F.col("_z") + 60).alias("_z")), ["tape"], "t", "_a", "_z", reach).select("tape", "from", "_chain", "t", "n", "heard")
    known = set(labels)

    def fold(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = ["tape", "from", "t0", "t1", "over_to", "words", "over_words"]
        if not len(p):
            return pd.DataFrame([], columns=columns)
        p, q = p.sort_values("n").reset_index(drop=True), q.sort_values(["t", "n"])
        tape = Tape(p, q, p["from"].iloc[0], p["to"].iloc[0], known, rules)
        cells = p[["start", "end", "token"]].to_dict("records")
        own = lambda a, z: [c for c, label in zip(cells[a:z], tape.label[a:z]) if not label]
        rows = []
        for x in tape.announcements():
            over = own(x["last"] + 1, x["over"] + 1) if x["over"] is not None else []
            rows.append((p["tape"].iloc[0], p["from"].iloc[0], x["t0"], x["t1"], x["over_to"], own(x["first"], x["last"] + 1), over))
        return pd.DataFrame(rows, columns=columns)

    kind = words.schema["tape"].dataType.simpleString()
    return cogrouped(near, around, ["tape", "from", "_chain"], fold, f"tape {kind}, `from` double, {ANNOUNCEMENT}")


def ends(token: str) -> bool:
    """Whether a word ends a sentence: a stop, but not a title's or an initial's."""
    word = token.strip()
    return word[-1:] in (".", "?", "!") and not re.match(TITLE, word)


def cuts(words: list[dict], rate: float, rules: Rules = Rules()) -> list[int]:
    """Places of the words at which an announcement is parted: between two times that it gives, where the
    second does not follow from the first. It is cut where the sentence starts that opens with the second;
    else after the sentence that closes with the first; else where the station last names itself between
    the two, or at the longest pause."""
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w["token"]) + 1
    said = [(bisect_right(starts, p) - 1, seconds, kind) for p, seconds, kind in announced_times(" ".join(w["token"] for w in words))]
    closed = [ends(w["token"]) for w in words]
    letters = ["".join(c for c in w["token"].lower() if "a" <= c <= "z") for w in words]
    out: list[int] = []
    for (i, first, how), (j, second, then) in zip(said, said[1:]):
        if abs(second - first - rate * (words[j]["start"] - words[i]["start"])) <= rules.out_of_step:
            continue
        after = min(next((k + 1 for k in range(i, len(words)) if closed[k]), len(words)), j)
        named = [k for k in range(after, j) if letters[k : k + 2] == ["this", "is"] and letters[k + 2] in CUE_OF and letters[k + 3 : k + 4] == [CUE_WORD] and (k == 0 or closed[k - 1])] if j + 2 < len(words) else []
        if then == "open":
            cut = next((k for k in range(j, after, -1) if closed[k - 1]), after)
        elif how == "close":
            cut = after
        elif named:
            cut = named[-1]
        else:
            cut = max(range(after, j + 1), key=lambda k: words[k]["start"] - words[k - 1]["end"])
        if cut and cut < len(words) and (not out or cut > out[-1]):
            out.append(cut)
    return out


def parted(found: DataFrame, rate: str = "rate", rules: Rules = Rules()) -> DataFrame:
    """Announcements as `announcements` gives them, with the rate of their segment: one row for each part,
    whose words join to the whole's. What is said over lines stays with the last part."""

    def split(batches):
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                words = list(r["words"]) if r["words"] is not None else []
                edges = [0, *cuts(words, float(r[rate]), rules), len(words)]
                for a, z in zip(edges, edges[1:]):
                    whole_end = z == len(words)
                    t0 = r["t0"] if a == 0 else words[a]["start"] - rules.lead
                    t1 = r["t1"] if whole_end else min(words[z - 1]["end"] + rules.lead, words[z]["start"] - rules.lead)
                    rows.append({**r, "t0": t0, "t1": max(t0, t1), "words": words[a:z], "over_to": r["over_to"] if whole_end else None, "over_words": r["over_words"] if whole_end else []})
            yield pd.DataFrame(rows, columns=p.columns)

    return found.mapInPandas(split, found.schema)


def moved(found: DataFrame, segments: DataFrame, mission: list[str], rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """found: mission, tape, t0, t1, said (the time that it gives, or null), opens (gives it in its first
    half); segments: mission, tape, from, to, get, rate. Announcements with `get` (null: its time is taken),
    and the segments afterwards. One that is out of its time is cut out of its segment and put where it says,
    behind others put there before, at most `hops` times; where another tape plays, it stays. These rows are
    few, so a mission is folded as a whole."""
    keys = mission
    s = segments.select(*keys, "tape", *[F.col(c).cast("double").alias(c) for c in ("from", "to", "get", "rate")])
    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in [*keys, "tape"])

    def fold(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        own, parts = _placed(p.sort_values(["tape", "t0"]).to_dict("records"), q.to_dict("records"), rules)
        head = (p if len(p) else q)[keys].iloc[0].to_dict()
        rows = [{**head, "tape": x["tape"], "from": x["t0"], "to": x["t1"], "get": x["get"], "rate": x["rate"], "spoken": True, "found": True} for x in own]
        rows += [{**head, **{c: x[c] for c in ("tape", "from", "to", "get", "rate")}, "spoken": x.get("spoken", False), "found": False} for x in parts]
        return pd.DataFrame(rows, columns=[*keys, "tape", "from", "to", "get", "rate", "spoken", "found"])

    both = stored(cogrouped(found.select(*keys, "tape", "t0", "t1", "said", "opens"), s, keys, fold, f"{kinds}, `from` double, `to` double, get double, rate double, spoken boolean, found boolean"), "moved")
    own = both.where("found").select(*keys, "tape", F.col("from").alias("t0"), F.col("to").alias("t1"), F.nanvl("get", F.lit(None).cast("double")).alias("get"), "rate")
    return own, both.where(~F.col("found")).drop("found")


def _end(s: dict) -> float:
    return s["get"] + s["rate"] * (s["to"] - s["from"])


def _placed(found: list[dict], segments: list[dict], rules: Rules) -> tuple[list[dict], list[dict]]:
    parts = sorted(segments, key=lambda s: (s["tape"], s["from"]))
    wanted = []
    for x in found:
        home = next((s for s in parts if s["tape"] == x["tape"] and s["from"] <= x["t0"] < s["to"]), None)
        x["get"], x["rate"] = (home["get"] + home["rate"] * (x["t0"] - home["from"]), home["rate"]) if home else (float("nan"), 1.0)
        if home is None or x["said"] is None or pd.isna(x["said"]):
            continue
        want = x["said"] + (rules.opens_after if x["opens"] else rules.closes_before - (x["t1"] - x["t0"]))
        off = x["get"] - want
        if not -rules.early <= off <= rules.late and abs(off) <= rules.far:
            wanted.append((x, want))
    for x, want in wanted:
        k = next((k for k, s in enumerate(parts) if s["tape"] == x["tape"] and s["from"] <= x["t0"] < s["to"]), None)
        if k is not None:
            home = parts.pop(k)
            before, after = {**home, "to": x["t0"]}, {**home, "from": x["t1"], "get": home["get"] + home["rate"] * (x["t1"] - home["from"])}
            parts[k:k] = [s for s in (before, after) if s["to"] - s["from"] > 1]
        length = x["t1"] - x["t0"]
        for hop in range(rules.hops + 1):
            block = [s for s in parts if s["get"] < want + length and _end(s) > want]
            if hop == rules.hops or not block or not all(s.get("spoken") for s in block):
                break
            want = max(map(_end, block)) + 1
        if not block:
            x["get"], x["rate"] = want, 1.0
            parts.append({"tape": x["tape"], "from": x["t0"], "to": x["t1"], "get": want, "rate": 1.0, "spoken": True})
        elif k is not None:
            parts.append({**home, "from": x["t0"], "to": x["t1"], "get": x["get"]})
        else:
            x["get"] = float("nan")
    return found, sorted(parts, key=lambda s: s["get"])
