"""Times for lines that have none, from the words heard between the timed lines around them.

The lines between two timed ones are a run. Its neighbours are found by as-of joins in buckets, its
heard words by an interval join, and one row then holds a run: as many lines and words as are said
within about an hour. The search in a run is in order, so it is a function of that row.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align
from . import joins

#: A run of this many lines is lined up with the tape at once.
LONG = 8
#: Lines of fewer words are not searched for by themselves.
LEAST = 3
#: Seconds: the longest stretch, how far the second search goes, how long a line without a next may
#: take, and the silence between two stretches of speech.
HOUR, FAR, OPEN, SILENCE = 3600.0, 900.0, 300.0, 0.8
PER_WORD = 0.3


def lined_up(lead: list[str], run: list[list[str]], tokens: list[str], times: list[float]) -> list[float | None]:
    """All lines of a run against all words at once, after the words of the line before. A line has a
    time if 0.6 of its words are matched, two in a row among them, and no line starts before another."""
    owner = [(k, p) for k, line in enumerate([lead, *run]) for p in range(len(line))]
    flat = [w for line in [lead, *run] for w in line]
    heard_at: list[dict[int, int]] = [{} for _ in range(len(run) + 1)]
    for m in SequenceMatcher(None, flat, tokens, autojunk=False).get_matching_blocks():
        for (k, p), j in zip(owner[m.a : m.a + m.size], range(m.b, m.b + m.size)):
            heard_at[k][p] = j
    out: list[float | None] = []
    for line, at in zip(run, heard_at[1:]):
        first = next((p for p, j in sorted(at.items()) if at.get(p + 1) == j + 1), None)
        sure = first is not None and len(line) >= LEAST and len(at) >= 0.6 * len(line)
        g = round(times[at[first]] - PER_WORD * first) if sure else None
        out.append(g if g is None else max([g, *(x for x in out if x is not None)]))
    return out


def in_turn(run: list[list[str]], tokens: list[str], times: list[float], share: float, least: int) -> list[float | None]:
    """Line after line, each among the words that follow the line found before it."""
    out, at = [], 0
    for line in run:
        end = at + 400 + 3 * len(line)
        g, found = align.find_start(line, tokens[at:end], times[at:end]) if len(line) >= least else (None, 0.0)
        if g is not None and found >= share:
            out.append(float(round(g)))
            at = next((j for j, t in enumerate(times) if t > g), len(times))
        else:
            out.append(None)
    return out


def loosely(line: list[str], before: list[str], g: float, until: float, words: list[tuple[float, float, str]]) -> tuple[float, str]:
    """A time between g, that of the line `before`, and `until`: where two words (and 0.4 of all), or the
    whole of a short line, come in order once most of the line before is said; else where the next
    stretch of speech starts; else just after the line before. Also says which."""
    near = [w for w in words if g - 1 <= w[0] <= until + 8]
    if not near:
        return g, "kept"
    skip = min(max(1, int(0.6 * len(before))), len(near))
    tried = [(sum(m.size for m in SequenceMatcher(None, line, [w[2] for w in near[j : j + len(line) + 3]], autojunk=False).get_matching_blocks()), -j) for j in range(skip, len(near)) if near[j][0] <= until + 5 and near[j][2] in line]
    n, j = max(tried, default=(0, 0))
    if n and (n == len(line) or n >= 2 and n >= 0.4 * len(line)):
        at, how = near[-j][0] - 0.2, "loose"
    else:
        stretch = next((k for k in range(skip, len(near)) if near[k][0] - near[k - 1][1] >= SILENCE), None)
        if stretch is not None and near[stretch][0] < until + 5:
            at, how = near[stretch][0] - 0.2, "speech"
        else:
            at, how = near[stretch - 1 if stretch is not None else -1][1] + 0.5, "after"
    return round(max(g, min(at, max(g, until - 0.3))), 1), how


def timed_run(lead: list[str], run: list[list[str]], g0: float, g1: float, words: list[tuple[float, float, str]]) -> list[tuple[float, str]]:
    """A time for each line of a run between g0 and g1, and how it came: found, loose, speech, after or
    kept. words: begin, end and token, in order of time, from g0 - 1 on."""

    def within(a: float, z: float) -> tuple[list[str], list[float]]:
        inside = [w for w in words if a <= w[0] <= z]
        return [w[2] for w in inside], [w[0] for w in inside]

    g1 = max(g1, g0 + 60)
    found: list[float | None] = [None] * len(run)
    if len(run) >= LONG:
        found = lined_up(lead, run, *within(g0 - 1, min(g1, g0 + HOUR)))
    for z, share, least in ((g1, 0.6, LEAST), (max(g1, g0 + FAR), 0.8, 6)):
        if any(x is not None for x in found) or z > g1 and not any(len(line) >= LEAST for line in run):
            break
        found = in_turn(run, *within(g0, z), share, least)
    out: list[tuple[float, str]] = []
    for k, line in enumerate(run):
        g, before = (out[-1][0], run[k - 1]) if out else (g0, lead)
        if found[k] is not None:
            out.append((max(found[k], g), "found"))
        else:
            until = next((x for x in found[k + 1 :] if x is not None), g1)
            out.append(loosely(line, before, g, until, words))
    return out


def timed_by_speech(lines: DataFrame, words: DataFrame, keys: list[str], order: str, at: str, timed: str, tokens: str, start: float = -3600.0, bucket: float = 10_000) -> DataFrame:
    """lines with `at` set for those that are not `timed` (a boolean), and `how` (null: timed before).
    words: keys, g, end, seq and token. Lines are in order of `order`, a number that no two of a key
    share; before the first timed line the clock is at `start`; after the last one a run has an hour.
    `bucket` is the span of `order` that a task of the as-of joins takes at least."""
    known = lines.where(F.col(timed)).select(*keys, F.col(order).alias("_o"), F.col(at).cast("double").alias("_at"), F.col(tokens).alias("_tokens"))
    open_ = lines.where(~F.coalesce(F.col(timed), F.lit(False)))
    own = open_.select(*keys, F.col(order).alias("_k"), F.col(tokens).alias("tokens"))
    before = joins.asof(own, known, keys, "_k", "_o", ["_at", "_tokens"], bucket, strict=True, to="_before")
    both = joins.asof(before, known.select(*keys, "_o", "_at"), keys, "_k", "_o", ["_at"], bucket, forward=True, strict=True, to="_after")
    g0 = F.coalesce("_before._at", F.lit(start))
    run = [*keys, "_first", "_lead", "_g0", "_g1"]
    marked = both.select(*keys, "_k", "tokens", F.coalesce("_before._o", F.lit(None)).alias("_first"), F.col("_before._tokens").alias("_lead"), g0.alias("_g0"), F.coalesce(F.col("_after._at"), g0 + HOUR).alias("_g1"))
    runs = marked.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("_k", "tokens"))).alias("_run"))
    until = F.greatest(F.col("_g1"), F.col("_g0") + FAR)
    spans = runs.select(*keys, "_first", (F.col("_g0") - 1).alias("_a"), (F.least(until, F.col("_g0") + HOUR) + 9).alias("_z"))
    said = joins.interval_join(words.select(*keys, F.col("g").alias("_g"), F.col("end").alias("_end"), "seq", "token"), spans, keys, "_g", "_a", "_z", FAR)
    heard = said.groupBy(*keys, "_first").agg(F.array_sort(F.collect_list(F.struct("_g", "seq", "_end", "token"))).alias("_words"))
    same = [runs[c].eqNullSafe(heard[c]) for c in [*keys, "_first"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    rows = runs.join(heard, cond, "left").select(*[runs[c] for c in [*keys, "_lead", "_g0", "_g1", "_run"]], "_words")
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    columns = [*keys, order, "_new", "how"]

    def placed_in(batches):
        # A row at a time becomes Python objects, which take many times a batch's size.
        for b in batches:
            out = []
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names if c != "_words"}
                said = b.column("_words")[k].values
                heard = [] if said is None else list(zip(*(said.field(c).to_pylist() for c in ("_g", "_end", "token"))))
                times = timed_run(r["_lead"] or [], [x["tokens"] or [] for x in r["_run"]], r["_g0"], r["_g1"], heard)
                out += [(*(r[c] for c in keys), x["_k"], float(g), how) for x, (g, how) in zip(r["_run"], times)]
            types = [*(b.schema.field(c).type for c in keys), b.schema.field("_run").type.value_type.field("_k").type, pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(columns), types)], names=columns)

    placed = rows.mapInArrow(placed_in, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", _new double, how string")
    return lines.join(placed, [*keys, order], "left").select(*[F.coalesce(F.col("_new"), F.col(at).cast("double")).alias(at) if c == at else F.col(c) for c in lines.columns], "how")
