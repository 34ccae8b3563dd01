"""Placement over the event table: users are tapes, views are anchors, other events are words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pieces, placement
from ..sources.tables import load


def events(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("tape"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") / 2).alias("start"), "value")


def segments(spark, sf_dir):
    """Anchors whose offsets lie in three bands, hence up to three kinds of pieces on each tape."""
    a = events(spark, sf_dir).where("event_type = 'view'").select("tape", F.col("start").alias("t"), (F.col("start") + 1000 * (F.col("seq") % 3) + F.col("value") / 100).alias("g"), F.lit(1.0).alias("w"))
    return placement.pieces_from_anchors(a, weight="w")


def anchor_pieces(spark, sf_dir):
    """Anchors whose offsets jump every 40 events, with strays, a tenth of them sure; pieces by all filters."""
    e = events(spark, sf_dir)
    level = 1000 + 45 * (F.floor(F.col("seq") / 2000) % 4) + F.when(F.col("value") < 4, 300).otherwise(F.col("value") / 100)
    weight = F.when(F.col("seq") % 3 == 0, 0.5).otherwise(1.0)
    a = e.where("event_type = 'view'").select("tape", F.col("start").alias("t"), (F.col("start") + level).alias("g"), weight.alias("w"), (F.col("seq") % 10 == 1).alias("sure"))
    w = e.where("event_type <> 'view'").select("tape", "start", (F.col("start") + F.col("value") / 10).alias("end"), F.col("event_type").alias("token"))
    lengths = e.groupBy("tape").agg(F.max("start").alias("seconds"))
    return pieces.pieces(a, w, lengths)


def disjoint_segments(spark, sf_dir):
    return placement.trimmed_segments(segments(spark, sf_dir))


def fixed_segments(spark, sf_dir):
    """Two segments for each tape, of rates one and a half, for the joins below."""
    tapes = events(spark, sf_dir).select("tape").distinct()
    halves = F.array(*[F.struct(*(F.lit(v).cast("double").alias(n) for n, v in zip(("from", "to", "get", "rate"), row))) for row in ((0, 900, 100, 1), (900, 4000, 5000, 0.5))])
    return tapes.select("tape", F.explode(halves).alias("s")).select("tape", "s.*")


def words_on_clock(spark, sf_dir):
    w = events(spark, sf_dir).select("tape", "seq", "start")
    return placement.words_on_clock(w, fixed_segments(spark, sf_dir)).select("seq", F.round("g", 6).alias("g"))


def unheard_lines(spark, sf_dir):
    """Purchases near which, on their tape's clock, nothing but views is heard."""
    e = events(spark, sf_dir)
    w = placement.words_on_clock(e.select("tape", "seq", "start", F.col("event_type").alias("token")).where("token <> 'purchase'"), fixed_segments(spark, sf_dir))
    l = placement.words_on_clock(e.where("event_type = 'purchase'").select("tape", F.col("seq").alias("line"), "start"), fixed_segments(spark, sf_dir)).select("tape", "line", "g")
    return placement.unheard(l.withColumnRenamed("g", "at"), w, ["tape"], "line", "at", 30, 30, ["view"]).select("line")


def retimed_lines(spark, sf_dir):
    """Lines of two kinds of events, moved to where those are heard in a row."""
    e = events(spark, sf_dir)
    w = placement.words_on_clock(e.select("tape", "seq", "start", F.col("event_type").alias("token")), fixed_segments(spark, sf_dir))
    l = w.where("token = 'error'").select("tape", F.col("seq").alias("line"), (F.col("g") + 7).alias("at"), F.array(F.lit("error"), F.lit("click")).alias("tokens"))
    return placement.retimed(l, w, ["tape"], "line", "at", "tokens", 200, 200, 1.0).select("line", F.round("at", 6).alias("at"), "moved")


def lines_on_tape(spark, sf_dir):
    """Clock times looked up in the segments of one tape, with the tape time, or null."""
    one = fixed_segments(spark, sf_dir).where("tape = '1'")
    l = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 9000).cast("double").alias("g"))
    return placement.lines_on_tape(l, one).select("line", F.coalesce("tape", F.lit("")).alias("tape"), F.coalesce(F.round("t", 6), F.lit(-1.0)).alias("t"))


QUERIES = {f.__name__: f for f in (anchor_pieces, disjoint_segments, words_on_clock, unheard_lines, retimed_lines, lines_on_tape)}

W = "e AS (SELECT CAST(user_id AS VARCHAR) AS tape, event_id AS seq, event_type, event_id / 2 AS start FROM events), w AS (SELECT tape, seq, event_type, CASE WHEN start < 900 THEN 100 + start ELSE 5000 + 0.5::DOUBLE * (start - 900) END AS g FROM e WHERE start < 4000)"
ORACLE_SQL = {
    "words_on_clock": f"WITH {W} SELECT seq, round(g, 6) AS g FROM w",
    "unheard_lines": f"WITH {W} SELECT seq AS line FROM w a WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM w b WHERE a.tape = b.tape AND b.event_type NOT IN ('purchase', 'view') AND b.g BETWEEN a.g - 30 AND a.g + 30)",
    "lines_on_tape": "WITH l AS (SELECT o_orderkey AS line, (o_orderkey % 9000)::DOUBLE AS g FROM orders) SELECT line, CASE WHEN g >= 100 AND g < 1000 OR g >= 5000 AND g < 6550 THEN '1' ELSE '' END AS tape, round(CASE WHEN g >= 100 AND g < 1000 THEN g - 100 WHEN g >= 5000 AND g < 6550 THEN 900 + (g - 5000) / 0.5 ELSE -1.0 END, 6) AS t FROM l",
}
