"""Queries over one ordered stream a key: longest runs and chains, readings resolved in order, lines put
where they are heard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clips, placement, runs, sync
from ..operators.joins import micros
from ..sources.tables import load


def lis_strict(spark, sf_dir):
    """Of each user's events, those whose values lie on a longest run that always rises."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return runs.longest_run(e, ["user_id"], ["event_id"], "value", strict=True)


def chain_points(spark, sf_dir):
    """Each user's longest chain of events that rise in time and value."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("t"), "value")
    return runs.longest_chain(e, ["user_id"], "t", "value")


def resolved_readings(spark, sf_dir):
    """Each type's events by id, with a clock reading (whole seconds since the first day) that is lost in
    a seventh, wrong in an eleventh and smudged in all others, put back in order."""
    e = load(spark, sf_dir, "events")
    t = F.col("event_id") * 7
    text = F.concat(*[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(t / 86400), F.floor(t / 3600) % 24, F.floor(t / 60) % 60, t % 60)])
    hole = (F.col("user_id") % 8 + 1).cast("int")
    smudged = F.concat(text.substr(F.lit(1), hole - 1), F.lit("?"), text.substr(hole + 1, F.lit(8)))
    read = F.when(F.col("event_id") % 7 == 3, None).when(F.col("event_id") % 11 == 5, F.floor(F.col("value") * 3600)).otherwise(t).cast("long")
    rows = e.select("event_type", "event_id", read.alias("time"), smudged.alias("pattern"), F.lit(None).cast("long").alias("hour"))
    return runs.resolve_times(rows, ["event_type"], "event_id", "time", "pattern", "hour", 10_000)


def spoken(spark, sf_dir):
    """The conversations as tapes: lines (turns with their words) and the words as recognised, an eleventh
    of them lost. A turn starts twenty seconds after the one before, and a pause of a quarter of an
    hour comes after every eighth."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    lines = c.select(F.col("conv_id").alias("tape"), F.col("turn").alias("line"), (F.col("turn") * 20 + F.floor(F.col("turn") / 8) * 900).cast("double").alias("start"), tokens.alias("tokens"))
    each = lines.select("tape", "line", "start", F.posexplode("tokens").alias("k", "token"))
    heard = each.where((F.col("tape") + F.col("line") * 3 + F.col("k")) % 11 != 0)
    return lines, heard.select("tape", (F.col("line") * 1000 + F.col("k")).alias("seq"), (F.col("start") + F.col("k") * 0.35).alias("t"), "token")


def synchronised_lines(spark, sf_dir):
    """Turns printed some seconds out, a seventh of them two minutes late, put where they are heard."""
    lines, words = spoken(spark, sf_dir)
    out = F.when(F.col("line") % 7 == 3, 120).otherwise((F.col("line") * 13) % 21 - 10)
    printed = lines.select("tape", "line", (F.col("start") + out).alias("g"), "tokens")
    return sync.synchronised(printed, words.withColumnRenamed("t", "g"), ["tape"]).select("tape", "line", "g", "moved")


def chained_lines(spark, sf_dir):
    """Turns between every fourth, which are known, by the one clear place where they are heard."""
    lines, words = spoken(spark, sf_dir)
    anchors = lines.where("line % 4 = 0").select("tape", "line", F.col("start").alias("t"))
    return sync.chained(lines.select("tape", "line", "tokens", F.lit(True).alias("open")), anchors, words, ["tape"])


def aligned_clips(spark, sf_dir):
    """Turns timed by a transcript whose clock is out, on recordings; every fifth may be absent."""
    lines, words = spoken(spark, sf_dir)
    l = lines.select(F.col("tape").alias("clip"), "line", (F.col("start") * 1.01 + 40).alias("at"), "tokens")
    w = words.select(F.col("tape").alias("clip"), "seq", F.col("t").alias("start"), "token")
    return clips.aligned(l, w, F.col("line") % 5 == 4).select("clip", "line", "time")


def rerun_lines(spark, sf_dir):
    """Turns moved to the longest stretch of their words that is heard around their printed time."""
    lines, words = spoken(spark, sf_dir)
    printed = lines.select("tape", "line", (F.col("start") - 15).alias("at"), "tokens")
    return placement.retimed_by_run(printed, words.withColumnRenamed("t", "g"), ["tape"], "line", "at", "tokens").select("tape", "line", F.round("at", 2).alias("at"), "moved")


QUERIES = {f.__name__: f for f in (lis_strict, chain_points, resolved_readings, synchronised_lines, chained_lines, aligned_clips, rerun_lines)}

#: Folds in order; tests hold them against the same folds on a list and against plain loops.
ORACLE_SQL: dict[str, str] = {}
