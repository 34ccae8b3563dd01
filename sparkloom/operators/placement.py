"""Placing a tape on a clock: anchors to pieces, pieces to segments, lines and words through them.

A segment maps tape seconds linearly: clock = get + rate * (t - from). Joins are by tape and time
bucket; only the grouping of anchors and the trimming of overlaps are folds, one tape in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from . import folds, joins


def pieces_from_anchors(anchors: DataFrame, tape: str = "tape", t: str = "t", g: str = "g", weight: str = "weight", least_weight: float = 3, most_slope: float = 0.01) -> DataFrame:
    """Anchors (tape time, clock time, weight) to pieces tape, from, to, get, rate, anchors: grouped
    by offset, groups of too little weight dropped, a clipped line fitted where they spread over five
    minutes, the intercept the median of what the slope leaves."""
    a = anchors.select(F.col(tape).alias("tape"), F.col(t).alias("t"), F.col(g).alias("g"), F.col(weight).alias("w"), (F.col(g) - F.col(t)).alias("o"))
    grouped = folds.group_by_offset(a, ["tape"], "t", "o")
    slope = F.when(F.max("t") - F.min("t") > 300, F.greatest(F.least(F.regr_slope("o", "t"), F.lit(most_slope)), F.lit(-most_slope))).otherwise(0.0)
    fits = grouped.groupBy("tape", "group").agg(F.sum("w").alias("weight"), F.min("t").alias("from"), F.max("t").alias("to"), slope.alias("slope"), F.count("*").alias("anchors"))
    kept = fits.where(F.col("weight") >= least_weight)
    level = grouped.join(kept, ["tape", "group"]).groupBy("tape", "group", "from", "to", "slope", "anchors").agg(F.median(F.col("o") - F.col("slope") * F.col("t")).alias("level"))
    return level.select("tape", "from", "to", (F.col("from") + F.col("level") + F.col("slope") * F.col("from")).alias("get"), (1 + F.col("slope")).alias("rate"), F.col("anchors").cast("long").alias("anchors"))


def trimmed_segments(pieces: DataFrame) -> DataFrame:
    """Pieces of a tape made disjoint; what is cut off at the front moves `get` along."""
    spans = folds.trim_overlaps(pieces.select("tape", "from", "to", "anchors"), ["tape"], "from", "to", "anchors")
    cut = spans.select("tape", F.col("from").alias("_f"), F.col("to").alias("_t"))
    hit = (pieces["from"] <= cut["_f"]) & (cut["_t"] <= pieces["to"])
    both = pieces.join(cut, "tape").where(hit)
    best = both.groupBy("tape", "_f", "_t").agg(F.max_by(F.struct("from", "get", "rate", "anchors"), F.struct("anchors", -F.col("from"))).alias("p"))
    return best.select("tape", F.col("_f").alias("from"), F.col("_t").alias("to"), (F.col("p.get") + F.col("p.rate") * (F.col("_f") - F.col("p.from"))).alias("get"), F.col("p.rate").alias("rate"), F.col("p.anchors").alias("anchors"))


def clock_of(t: Column) -> Column:
    return F.col("get") + F.col("rate") * (t - F.col("from"))


def tape_of(g: Column) -> Column:
    return F.col("from") + (g - F.col("get")) / F.col("rate")


def words_on_clock(words: DataFrame, segments: DataFrame, width: float = 600) -> DataFrame:
    """Recognised words (tape, start, ...) with the clock time `g` that their segment gives them."""
    s = segments.select("tape", "from", "to", "get", "rate")
    return joins.interval_join(words, s, ["tape"], "start", "from", "to", width).withColumn("g", clock_of(F.col("start"))).drop("from", "to", "get", "rate")


def lines_on_tape(lines: DataFrame, segments: DataFrame, g: str = "g", width: float = 600) -> DataFrame:
    """Lines with the tape and tape time of the segment that covers them, or nulls."""
    s = segments.select("tape", "from", "to", "get", "rate", F.col("get").alias("_a"), (F.col("get") + (F.col("to") - F.col("from")) * F.col("rate")).alias("_z"))
    on = joins.interval_join(lines, s, [], g, "_a", "_z", width)
    best = on.groupBy(*lines.columns).agg(F.max_by(F.struct("tape", tape_of(F.col(g)).alias("t")), F.col("_a")).alias("m"))
    return lines.join(best, [*lines.columns], "left").select(*lines.columns, F.col("m.tape").alias("tape"), F.col("m.t").alias("t"))


def heard_near(lines: DataFrame, words: DataFrame, keys: list[str], line: str, at: str, before: float, after: float) -> DataFrame:
    """For each line the words heard in its time band, in order of time and sequence: line, words and
    times. A band is bounded by how fast people talk."""
    pairs = joins.band_join(lines.select(*keys, line, at), words.select(*keys, F.col("g").alias("_g"), "seq", "token"), keys, at, "_g", before, after)
    return pairs.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct("_g", "seq", "token"))).alias("w")).select(*keys, line, F.transform("w", lambda x: x["token"]).alias("words"), F.transform("w", lambda x: x["_g"]).alias("times"))


def retimed(lines: DataFrame, words: DataFrame, keys: list[str], line: str, at: str, tokens: str, before: float = 30, after: float = 60, share: float = 0.6) -> DataFrame:
    """Lines moved to where their words are heard, if enough of them are; others stay. Adds moved."""
    near = heard_near(lines, words, keys, line, at, before, after)
    found = lines.join(near, [*keys, line], "left").withColumn("_f", F.when(F.col("words").isNotNull(), align.find_udf(tokens, F.coalesce("words", F.array().cast("array<string>")), F.coalesce("times", F.array().cast("array<double>")))))
    sure = F.coalesce(F.col("_f.share") >= share, F.lit(False))
    return found.withColumn(at, F.when(sure, F.col("_f.t")).otherwise(F.col(at))).withColumn("moved", sure).select(*lines.columns, "moved")


def retimed_by_run(lines: DataFrame, words: DataFrame, keys: list[str], line: str, at: str, tokens: str, before: float = 45, after: float = 120) -> DataFrame:
    """Lines of two words or more moved to where the longest stretch of their words is heard
    (`align.find_run`), if it is half a second away at least; others stay. Adds moved."""
    near = heard_near(lines.where(F.size(tokens) > 1), words, keys, line, at, before, after)
    found = lines.join(near, [*keys, line], "left").withColumn("_f", align.find_run_udf(tokens, "words", "times"))
    off = F.coalesce(F.abs(F.col("_f.t") - F.col(at)) >= 0.5, F.lit(False))
    return found.withColumn("moved", off).withColumn(at, F.coalesce(F.round("_f.t", 1), F.col(at))).select(*lines.columns, "moved")


def unheard(lines: DataFrame, words: DataFrame, keys: list[str], line: str, at: str, before: float, after: float, filler: list[str]) -> DataFrame:
    """Lines near which no word but filler is heard."""
    real = words.where(~F.col("token").isin(*filler)).select(*keys, F.col("g").alias("_g"))
    heard = joins.band_join(lines.select(*keys, line, at), real, keys, at, "_g", before, after).select(*keys, line).distinct()
    return lines.join(heard, [*keys, line], "left_anti")
