"""From anchors to pieces of a tape: single stretches, filters among neighbours, rivals, cuts, fits.

An anchor says that tape second t is second g of a clock, and what it weighs. Groups of anchors of one
offset become pieces if they hold against their neighbours. All rules on neighbours are windows over
one row a group, and no table of groups is broadcast; only what looks into spans that overlap (splits, rivals) is a fold, over one chain of
overlapping groups at a time. The rules' numbers are those of the task and stand in `Rules`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import folds
from .joins import interval_join
from .sequence import clusters


@dataclass(frozen=True)
class Rules:
    reach: float = 600  #: a group goes on past a stray anchor for so long
    step: float = 8  #: offsets of one group follow each other so closely
    heavy: float = 3  #: a group of this weight stands by itself
    solid: float = 2  #: a group of this weight is a neighbour to judge misprints by
    few: int = 5  #: a group of so many anchors at most may be a mismatch
    agree: float = 30  #: offsets that agree; a jump beyond it is real
    off: float = 60  #: out of line with neighbours that agree
    agree_closely: float = 10
    off_closely: float = 20
    spread: float = 300  #: anchors spread wider than this give a slope
    slope: float = 0.01  #: at most
    last_look: float = 20  #: before a jump back, where the pause is sought
    bridge: float = 240  #: the longest announcement that is left out before a jump back
    pause: float = 1.5  #: parts two speeches
    lead: float = 0.3  #: a piece ends so long before an announcement


def stretches(groups: list[np.ndarray], times: np.ndarray, least: int) -> list[np.ndarray]:
    """Cuts groups of rows until none reaches around another of at least `least` rows: it is cut into
    what lies before, within and after that one's span. Rows are places in the ascending `times`; groups
    come and go in order of their first ones."""
    parts = [g for g in groups if len(g)]
    while parts:
        first, last = times[[p[0] for p in parts]], times[[p[-1] for p in parts]]
        inner = np.array([len(p) >= least for p in parts])[:, None]
        around = inner & (first[None, :] < first[:, None]) & (last[None, :] > last[:, None])
        if not around.any():
            break
        k, outer = divmod(int(around.argmax()), len(parts))
        own = times[parts[outer]]
        parts[outer], within, after = np.split(parts[outer], [np.searchsorted(own, first[k], "left"), np.searchsorted(own, last[k], "right")])
        parts += [p for p in (after, within) if len(p)]
    return sorted(parts, key=lambda p: p[0])


def unrivalled(groups: list[np.ndarray], weights: list[float]) -> list[int]:
    """Places of the groups that stay. From the lightest on, a group goes if half or more of its times
    are within the span of one that stays and is no lighter, unless it reaches around that one."""
    stay = set(range(len(groups)))
    for k in sorted(stay, key=lambda k: weights[k]):
        mine = groups[k]
        for o in stay - {k}:
            low, high = groups[o][0], groups[o][-1]
            shared = int(((mine >= low) & (mine <= high)).sum())
            if weights[o] >= weights[k] and shared and 2 * shared >= len(mine) and not (mine[0] < low and high < mine[-1]):
                stay.discard(k)
                break
    return sorted(stay)


def single_stretches(anchors: DataFrame, keys: list[str], group: str, at: str, weight: str, row: str, least: int = 1, rivals: bool = False, width: float = 3600) -> DataFrame:
    """Groups regrouped so that each is a single stretch (`stretches`); with `rivals`, the lighter of
    two that overlap goes. `group` becomes the `row` of a group's first anchor. Chains of groups whose
    spans overlap are folded side by side."""
    spans = anchors.groupBy(*keys, group).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    chained = clusters(spans, keys, "_a", F.col("_z"), width, "_cluster").select(*keys, group, "_cluster")
    columns = [c for c in anchors.columns if c != group]
    rows = anchors.join(chained.hint("merge"), [*keys, group]).select(*columns, group, "_cluster")
    place, weigh, name, own_group = (rows.columns.index(c) for c in (at, weight, row, group))

    def fold(p: list[tuple]) -> list[tuple]:
        own: dict = {}
        for k, r in enumerate(p):
            own.setdefault(r[own_group], []).append(k)
        if len(own) == 1:
            held = {int(p[0][name]): range(len(p))}
        else:
            times = np.array([r[place] for r in p], float)
            held = {int(p[part[0]][name]): part for part in stretches([np.array(g) for g in own.values()], times, least)}
        names = list(held)
        if rivals and len(names) > 1:
            weights = np.array([r[weigh] for r in p], float)
            names = [names[k] for k in unrivalled([times[held[n]] for n in names], [float(weights[held[n]].sum()) for n in names])]
        return [(*p[k][:own_group], n) for n in names for k in held[n]]

    return folds.by_rows(rows, [*keys, "_cluster"], [at, row], fold, [*columns, group], {group: "bigint"})


def _summed(anchors: DataFrame) -> DataFrame:
    """One row a group: span, number, weight, median offset, whether it holds a sure anchor."""
    return anchors.groupBy("tape", "group").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.sum("w").alias("weight"), F.median("o").alias("off"), F.max("sure").alias("sure"))


def _line(up: bool = True) -> Window:
    order = ("first", "group") if up else (F.desc("first"), F.desc("group"))
    return Window.partitionBy("tape").orderBy(*order)


def _beside(s: DataFrame, which: Column) -> DataFrame:
    """Adds `before` and `after`: offsets of the nearest groups on both sides that `which` holds of."""
    off = F.when(which, F.col("off"))
    past = (Window.unboundedPreceding, -1)
    return s.withColumn("before", F.last(off, True).over(_line().rowsBetween(*past))).withColumn("after", F.last(off, True).over(_line(False).rowsBetween(*past)))


def _apart(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def standing(groups: DataFrame, rules: Rules) -> DataFrame:
    """The groups (as `_summed` gives them) that pass four filters: misprints, which sit between two
    solid groups of one offset; light groups without a sure anchor that jumps; groups out of line with
    both neighbours; light groups within a heavy one's span."""
    r, few, heavy = rules, F.col("n") <= rules.few, F.col("weight") >= rules.heavy
    s = _beside(groups, F.col("weight") >= r.solid)
    misprint = few & F.col("sure") & (_apart("before", "after") <= r.agree) & (_apart("off", "before") > r.agree)
    s = _beside(s.where(~F.coalesce(misprint, F.lit(False))), heavy)
    jumps = F.coalesce(_apart("off", "before") > r.agree, F.lit(True)) & F.coalesce(_apart("off", "after") > r.agree, F.lit(True))
    s = _beside(s.where(heavy | (F.col("sure") & jumps)), F.lit(True))
    between = _apart("before", "after")
    out_of_line = few & (((between <= r.agree) & (_apart("off", "before") > r.off)) | ((between <= r.agree_closely) & (_apart("off", "before") > r.off_closely)))
    s = s.where(~F.coalesce(out_of_line, F.lit(False))).withColumn("_ms", F.round(F.col("first") * 1000).cast("long"))
    earlier = Window.partitionBy("tape").orderBy("_ms").rangeBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(heavy, F.col("last"))).over(earlier)
    return s.withColumn("_reached", reached).where(heavy | ~F.coalesce(F.col("_reached") > F.col("last"), F.lit(False))).drop("_ms", "_reached", "before", "after")


def grouped(anchors: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """anchors: tape, t, g, w (weight), sure. The anchors of the groups that stand, with `o` (offset)
    and `group`. Anchors without a tape time or clock time go."""
    rows = anchors.where("t is not null and g is not null").select("tape", F.col("t").cast("double").alias("t"), F.col("w").cast("double").alias("w"), F.coalesce("sure", F.lit(False)).alias("sure"), (F.col("g") - F.col("t")).cast("double").alias("o"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "anchors")
    by_offset = folds.group_by_offset(rows, ["tape"], "t", "o", rules.reach, rules.step)
    single = stored(single_stretches(by_offset, ["tape"], "group", "t", "w", "row", least=3), "stretches")
    kept = standing(_summed(single), rules).select("tape", "group")
    return single_stretches(single.join(kept.hint("merge"), ["tape", "group"]), ["tape"], "group", "t", "w", "row", rivals=True)


def cuts(groups: DataFrame, words: DataFrame, rules: Rules = Rules(), handover: tuple[tuple[str, ...], str] = (("apollo", "mission"), "control")) -> DataFrame:
    """groups: as `_summed`. words: tape, start, end, token, in order of start. For each group that
    follows another: `ends`, where the piece before it ends, and `starts`, where its own starts. Both
    are the middle of the longest pause between the two; where the clock jumps back, the pause is
    sought shortly before the group, and an announcement that hands over (one of the words, then the
    word) is left out, from the start of its speech."""
    lag = lambda c: F.lag(c).over(_line())
    gaps = groups.select("tape", "group", lag("last").alias("a"), F.col("first").alias("b"), lag("off").alias("_old"), "off").where("a is not null")
    gaps = gaps.withColumn("back", F.col("off") < F.col("_old") - rules.agree).withColumn("low", F.when(F.col("back"), F.greatest("a", F.col("b") - rules.last_look)).otherwise(F.col("a")))
    line = Window.partitionBy("tape").orderBy("start")
    w = words.select("tape", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "token")
    spaced = w.withColumn("_end", F.lag("end").over(line)).withColumn("_said", F.lag("token").over(line))
    said = spaced.withColumn("speech", F.last(F.when(F.col("_end").isNull() | (F.col("start") - F.col("_end") >= rules.pause), F.col("start")), True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # Words between the borders of a gap; the pauses are those before each, and the one after the last.
    span = gaps.select("tape", "group", "a", "b", "low", "back", F.col("b").alias("_till"))
    inside = interval_join(said, span, ["tape"], "start", "a", "_till", 600)
    # An interval is half open; a word that starts on its end belongs to the group, and only bounds the pause.
    own = F.col("start") >= F.col("low")
    before = Window.partitionBy("tape", "group").orderBy("start")
    parts = inside.where(own).withColumn("_from", F.coalesce(F.lag("end").over(before), F.col("low")))
    pauses = parts.select("tape", "group", (F.col("start") - F.col("_from")).alias("length"), ((F.col("start") + F.col("_from")) / 2).alias("middle"))
    final = parts.groupBy("tape", "group", "b", "low").agg(F.max_by("end", "start").alias("_from")).select("tape", "group", (F.col("b") - F.col("_from")).alias("length"), ((F.col("b") + F.col("_from")) / 2).alias("middle"))
    longest = pauses.unionByName(final).groupBy("tape", "group").agg(F.max(F.struct("length", "middle")).alias("p"))
    bridges = inside.where(F.col("back") & (F.col("start") > F.col("a")) & (F.col("token") == handover[1]) & F.col("_said").isin(*handover[0]))
    spoken = bridges.groupBy("tape", "group", "a", "b").agg(F.max_by("speech", "start").alias("s"))
    left_out = spoken.select("tape", "group", F.when(F.col("b") - F.greatest("s", "a") <= rules.bridge, F.greatest(F.col("a"), F.col("s") - rules.lead)).alias("_ends"))
    joined = gaps.join(longest.hint("merge"), ["tape", "group"], "left").join(left_out.hint("merge"), ["tape", "group"], "left")
    middle = F.coalesce("p.middle", (F.col("low") + F.col("b")) / 2)
    return joined.select("tape", "group", F.coalesce("_ends", middle).alias("ends"), middle.alias("starts"))


def pieces(anchors: DataFrame, words: DataFrame, lengths: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """anchors and words as above; lengths: tape, seconds. tape, from, to, get (clock at `from`), rate,
    anchors, first: the pieces of each tape, which meet at cuts or leave an announcement out."""
    own = stored(grouped(anchors, rules), "grouped")
    s = _summed(own)
    steep = F.when(F.max("t") - F.min("t") > rules.spread, F.greatest(F.least(F.regr_slope("o", "t"), F.lit(rules.slope)), F.lit(-rules.slope)))
    slopes = own.groupBy("tape", "group").agg(F.coalesce(steep, F.lit(0.0)).alias("slope"))
    level = own.join(slopes.hint("merge"), ["tape", "group"]).groupBy("tape", "group", "slope").agg(F.median(F.col("o") - F.col("slope") * F.col("t")).alias("level"))
    edges = cuts(s, words, rules)
    rows = s.join(level.hint("merge"), ["tape", "group"]).join(edges.hint("merge"), ["tape", "group"], "left").join(lengths.select("tape", "seconds").hint("merge"), "tape")
    start = F.coalesce("starts", F.lit(0.0))
    end = F.coalesce(F.lead("ends").over(_line()), F.col("seconds").cast("double"))
    return rows.select("tape", F.round(start, 2).alias("from"), F.round(end, 2).alias("to"), F.round(F.col("level") + (1 + F.col("slope")) * start, 2).alias("get"), F.round(1 + F.col("slope"), 6).alias("rate"), F.col("n").alias("anchors"), F.round("first", 2).alias("first"))
