"""Lines put where they are heard: in order along a stretch of tape, and between lines already found.

Lines and words share a clock; words are numbered along each key (a stretch of tape). A line can only
reach words between five minutes before its printed time and a minute after, and pushes the cursor on
by its own length, so in numbers of words each line has a span, and lines whose spans do not meet
cannot affect each other. Chains of spans are folded side by side; what a fold knows of the chain before
it (when speech last ended) is handed on by a window over chains, and only chains that need it are
folded once more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align
from ..sources.scratch import stored
from . import folds, runs
from .joins import asof, interval_join
from .sequence import clusters, numbered

#: Seconds before and after a printed time, seconds before a late one, words of a line
#: that can be sought at all and of one that can be late, and shares of its words that must be heard.
BEFORE, AFTER, LATE, LEAST, LONG, SHARE, SURE = 30, 60, 300, 3, 6, 0.6, 0.8
#: How much of a line its words take before the next can start; seconds from one word to the
#: next within speech, and at most for each word; and the time that a line takes where it is not heard.
OVERLAP, BREATH, SLOW, STARTS, PER_WORD = 0.7, 2.0, 0.6, 0.5, 0.35


@dataclass
class Tape:
    """Words of a stretch, and what the walk along it has reached."""

    at: list[float]
    said: list[str]
    cursor: int = 0
    spoken: float | None = None  # when the last line found has been said
    heard: bool = False
    waiting: list[int] = field(default_factory=list)

    def place(self, t: float) -> int:
        return bisect_left(self.at, t)

    def seek(self, how, tokens: list[str], low: int, high: int) -> tuple[float | None, float]:
        return how(tokens, self.said[low:high], self.at[low:high]) if low < high else (None, 0.0)

    def passed(self, t: float, n: int) -> int:
        """The first word that the line after one of n words at t can start with."""
        return self.place(t) + max(1, int(OVERLAP * n))

    def silence(self, t: float, n: int) -> float:
        """When a line of n words that starts at t has been said."""
        k = self.place(t)
        latest = self.at[k] + BREATH + SLOW * n
        while k + 1 < len(self.at) and self.at[k + 1] - self.at[k] < BREATH and self.at[k + 1] <= latest:
            k += 1
        return self.at[k] + STARTS


def spread(gap: list[int], left: float | None, right: float) -> dict[int, float]:
    """Times for lines that were said between left and right: over the last minute before right."""
    start = max(right - 3 * len(gap) if left is None else left, right - 60)
    wide = right - start > 1
    return {q: round(start + (right - start) * k / len(gap) if wide else right - 0.5, 1) for k, q in enumerate(gap)}


def in_order(lines: list[tuple[float, list[str]]], at: list[float], said: list[str], before: float | None = None) -> tuple[list[float], bool, float | None, bool]:
    """Times of the lines (printed time, words; in order of time), whether any was found, when speech
    ended after the last one found (with the lines that wait), and whether the end of earlier speech
    would have made a difference. before: that end, where it is known."""
    tape, out, asked = Tape(at, said, spoken=before), [g for g, _ in lines], False
    for k, (g, words) in enumerate(lines):
        n = len(words)
        if n < LEAST:
            tape.waiting.append(k)
            continue
        low = max(tape.cursor, tape.place(g - BEFORE))
        t, share = tape.seek(align.find_start, words, low, bisect_right(at, g + AFTER))
        late = False
        if (t is None or share < SHARE) and n >= LONG:
            first = max(tape.cursor, tape.place(g - LATE))
            t, share = tape.seek(partial(align.find_unique, least=SURE), words, first, min(len(at), low + n))
            late = t is not None and share >= SURE
            t = t if late else None
        if t is None or share < SHARE:
            tape.waiting.append(k)
            continue
        if late:
            asked |= _brought_back(tape, lines, out, t)
        tape.cursor, tape.spoken, tape.waiting, tape.heard = tape.passed(t, n), tape.silence(t, n), [], True
        if abs(t - g) >= 0.5:
            out[k] = round(t, 1)
    ends = [x for x in [tape.spoken, *(_said_by(lines[q]) for q in tape.waiting)] if x is not None]
    return out, tape.heard, max(ends, default=None), asked


def _said_by(line: tuple[float, list[str]]) -> float:
    return line[0] + STARTS + PER_WORD * len(line[1])


def _brought_back(tape: Tape, lines, out: list[float], t: float) -> bool:
    """Lines that wait and were printed after t come back before it: where they are heard from the
    cursor on, or over the gaps between those. Says whether the end of earlier speech was missing."""
    end, cursor, found = tape.place(t), tape.cursor, {}
    back = [q for q in tape.waiting if lines[q][0] > t]
    for q in back:
        words = lines[q][1]
        at, share = tape.seek(partial(align.find_unique, least=SHARE), words, cursor, end) if len(words) >= LEAST else (None, 0.0)
        if at is not None and share >= SHARE:
            found[q], cursor = at, tape.passed(at, len(words))
    stay = [_said_by(lines[q]) for q in tape.waiting if lines[q][0] <= t]
    left = max((x for x in [tape.spoken, *stay] if x is not None), default=None)
    missing, gap = left is None and bool(back) and back[0] not in found, []
    for q in [*back, None]:
        if q is not None and q not in found:
            gap.append(q)
            continue
        right = t if q is None else found[q]
        for u, g in spread(gap, left, right).items():
            out[u] = g
        gap = []
        if q is not None:
            out[q], left = round(right, 1), tape.silence(right, len(lines[q][1]))
    # Lines that stay before t bound the gap as well as speech does, but earlier speech may end later.
    return missing or (tape.spoken is None and not tape.heard and bool(back))


def synchronised(lines: DataFrame, words: DataFrame, keys: list[str], width: float = 600, step: int = 2000) -> DataFrame:
    """lines: keys, line, g, tokens; words: keys, g, seq, token. Lines with `g` where they are heard, and
    `moved`. Lines without a time or words keep their place in the result and are not sought. width:
    seconds, step: words, that are looked up together."""
    w = stored(numbered(words.where("g is not null").select(*keys, F.col("g").cast("double").alias("_g"), "seq", "token"), keys, "_g", ["seq"], width, "_n"), "numbered")
    usable = F.col("g").isNotNull() & F.col("tokens").isNotNull()
    l = lines.where(usable).select(*keys, "line", F.col("g").cast("double").alias("g"), "tokens")
    l = l.withColumn("_low", F.col("g") - LATE).withColumn("_high", F.col("g") + AFTER)
    l = asof(l, w, keys, "_low", "_g", ["_n"], width, strict=True, to="_a")
    l = asof(l, w, keys, "_high", "_g", ["_n"], width, to="_z")
    n = lambda c: F.coalesce(F.col(f"{c}._n") + 1, F.lit(0)).cast("double")
    spans = l.select(*keys, "line", "g", "tokens", n("_a").alias("_begin"), (n("_z") + 2 * F.size("tokens") + 1).alias("_last"))
    chained = stored(clusters(spans, keys, "_begin", F.col("_last"), step, "_chain"), "chains")
    bounds = chained.groupBy(*keys, "_chain").agg(F.min("_begin").alias("_from"), (F.max("_last") + 1).alias("_to"))
    heard = stored(interval_join(w, bounds, keys, "_n", "_from", "_to", step).select(*keys, "_chain", "_g", "_n", "token"), "heard")
    columns = [*keys, "_chain", "line", "g", "_found", "_ends", "_asked"]

    def fold(p: list[dict], q: list[dict]) -> list[tuple]:
        p, q = sorted(p, key=lambda r: (r["g"], r["line"])), sorted(q, key=lambda r: r["_n"])
        g, found, ends, asked = in_order([(r["g"], r["tokens"]) for r in p], [r["_g"] for r in q], [r["token"] for r in q], p[0]["_before"])
        return [(*(r[k] for k in keys), r["_chain"], r["line"], new, found, ends, asked) for r, new in zip(p, g)]

    def folded(part: DataFrame) -> DataFrame:
        return folds.by_rows_of_both(part, heard, [*keys, "_chain"], fold, columns, {"_found": "boolean", "_ends": "double", "_asked": "boolean"})

    first = stored(folded(chained.withColumn("_before", F.lit(None).cast("double"))), "in-order")
    ends = first.groupBy(*keys, "_chain").agg(F.max("_found").alias("_found"), F.max("_ends").alias("_ends"), F.max("_asked").alias("_asked"))
    line = Window.partitionBy(*keys).orderBy("_chain")
    so_far = (Window.unboundedPreceding, 0)
    state = ends.withColumn("_since", F.sum(F.col("_found").cast("int")).over(line.rowsBetween(*so_far)))
    state = state.withColumn("_state", F.max("_ends").over(Window.partitionBy(*keys, "_since").orderBy("_chain").rowsBetween(*so_far))).withColumn("_before", F.lag("_state").over(line))
    again = stored(state.where(F.col("_asked") & F.col("_before").isNotNull()).select(*keys, "_chain", "_before"), "again")
    second = folded(chained.join(again, [*keys, "_chain"]))
    settled = first.join(again, [*keys, "_chain"], "left_anti").unionByName(second).select(*keys, "line", F.col("g").alias("_new"))
    new = F.coalesce("_new", "g")
    return lines.join(settled, [*keys, "line"], "left").withColumn("moved", F.coalesce(new != F.col("g"), F.lit(False))).withColumn("g", new).select(*lines.columns, "moved")


def chained(lines: DataFrame, anchors: DataFrame, words: DataFrame, keys: list[str], wide: float = 1200, margin: float = 30, block: int = runs.BLOCK) -> DataFrame:
    """A second look for lines between lines found. lines: keys, line (its number in order), tokens, open
    (may be sought); anchors: keys, line, t of lines found; words: keys, t, seq, token. Anchors out of
    order do not count. Between two neighbours at most `wide` apart, each line is sought after the one
    before it, by its one clear place; each find bounds the next, so that a recorder that stopped in
    between does not matter. Returns keys, line, t, again (an anchor that its own gap confirms)."""
    one = anchors.groupBy(*keys, "line").agg(F.max("t").alias("t"))
    found = stored(runs.longest_run(one, keys, ["line"], "t", strict=True, block=block), "found")
    near = Window.partitionBy(*keys).orderBy("line")
    gaps = stored(found.withColumn("_next", F.lead("t").over(near)).withColumn("_after", F.lead("t", 2).over(near)).where((F.col("_next") > F.col("t")) & (F.col("_next") <= F.col("t") + wide)), "gaps")
    spans = gaps.select(*keys, F.col("line").alias("_gap"), (F.col("t") - 5).alias("_from"), (F.greatest("_next", F.when(F.col("_after") <= F.col("_next") + wide, F.col("_after")).otherwise(F.col("_next"))) + margin + 0.001).alias("_to"))
    heard = interval_join(words.select(*keys, F.col("t").alias("_t"), "seq", "token"), spans, keys, "_t", "_from", "_to", wide)
    said = heard.groupBy(*keys, "_gap").agg(F.array_sort(F.collect_list(F.struct("_t", "seq", "token"))).alias("_words"))
    inside = asof(lines.select(*keys, F.col("line").cast("double").alias("_at"), "line", "tokens", "open"), gaps.select(*keys, F.col("line").cast("double").alias("_line"), F.col("line").alias("_gap")), keys, "_at", "_line", ["_gap"], 10_000, strict=True, to="_g")
    rows = inside.select(*keys, "line", "tokens", "open", F.col("_g._gap").alias("_gap")).join(gaps.select(*keys, F.col("line").alias("_gap"), "t", "_next", "_after"), [*keys, "_gap"])
    # A line beyond the gap's other end belongs to a later gap, or to none; the end itself is confirmed.
    ends = found.select(*keys, "line", F.lit(True).alias("_end"))
    rows = rows.join(ends, [*keys, "line"], "left")

    def fold(p: list[dict], q: list[dict]) -> list[tuple]:
        p = sorted(p, key=lambda r: r["line"])
        cells = sorted((w["_t"], w["seq"], w["token"]) for w in q[0]["_words"]) if q else []
        at, said = [c[0] for c in cells], [c[2] for c in cells]
        out, last = [], None
        for r in p:
            last = r["t"] if last is None else last
            words, end = r["tokens"] if r["tokens"] is not None else [], r["_next"]
            if r["_end"] is True:
                after = r["_after"]
                if len(words) >= LONG and after is not None and last < after <= last + wide:
                    t, share = _clear(words, at, said, bisect_left(at, last - 5), bisect_right(at, after + margin))
                    if t is not None and abs(t - end) <= 15:
                        out.append((r["line"], end, True))
                break
            if r["open"] and len(words) >= LONG and last < end <= last + wide:
                t, share = _clear(words, at, said, bisect_left(at, last), bisect_right(at, end + margin))
                if t is not None:
                    out.append((r["line"], t, False))
                    last = t
        return [(*(p[0][k] for k in keys), line, float(t), again) for line, t, again in out]

    return folds.by_rows_of_both(rows, said, [*keys, "_gap"], fold, [*keys, "line", "t", "again"], {"t": "double", "again": "boolean"})


def _clear(words: list[str], at: list[float], said: list[str], low: int, high: int) -> tuple[float | None, float]:
    """One clear place with three quarters of the words; of a long line three fifths are enough."""
    least = SHARE if len(words) >= 15 else 0.75
    t, share = align.find_unique(words, said[low:high], at[low:high], least=least) if low < high else (None, 0.0)
    return (t, share) if t is not None and share >= least else (None, share)
