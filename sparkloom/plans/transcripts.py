"""Transcript operators over the event and text tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import transcripts as tr
from ..sources.tables import load


def after_preamble(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tr.without_preamble(e, ["user_id"], "event_id", F.col("event_type") == "signup")


def stitched_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tr.stitched(e, ["user_id"], "event_id", F.col("event_type") == "signup", "event_type")


def page_streams(spark, sf_dir):
    """Each day of a kind as a page with a letter by its count; letters without a like neighbour
    take the last that has one."""
    d = load(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("page")).agg(F.count("*").alias("n"))
    pages = d.select("event_type", "page", F.when(F.col("n") % 5 > 0, F.substring(F.lit("AB"), (F.col("n") % 2 + 1).cast("int"), F.lit(1))).alias("letter"))
    return tr.page_letters(pages, ["event_type"], "page", "letter").select("event_type", "page", F.coalesce("stream", F.lit("")).alias("stream"))


def agreeing_offsets(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), (F.col("event_id") + F.round(F.col("value") * 10)).alias("g"))
    return tr.agreeing(e, ["user_id"], "t", "g", 1.5).select("event_id")


def best_offsets(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.round("value", 1).alias("offset"), (F.col("event_id") % 7).alias("score"))
    return tr.best_sample(e, ["user_id"], "offset", "score", 3).select("user_id", F.round("offset", 6).alias("offset"), "n")


def backwards_flags(spark, sf_dir):
    """Users with three or more values that beat the next by thirty."""
    e = load(spark, sf_dir, "events")
    nxt = F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("beats", F.col("value") - nxt > 30).groupBy("user_id").agg((F.count_if("beats") >= 3).alias("backwards"))


def window_votes(spark, sf_dir):
    """Windows of twelve tokens, every six, of the turns of a conversation: the turn of another
    conversation that shares most of their rare pairs of words."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.grams(text.tokens(F.col("text")), 2)).alias("at", "gram"))
    once = t.select("conv_id", "gram").distinct()
    rare = once.groupBy("gram").agg(F.count("*").alias("n")).where("n between 2 and 5")
    q = t.join(rare, "gram").select("conv_id", "turn", "gram", "n", F.explode(F.array(F.floor(F.col("at") / 6), F.floor(F.col("at") / 6) - 1)).alias("window")).where("window >= 0").distinct()
    votes = q.join(once.withColumnRenamed("conv_id", "other"), "gram").where("other <> conv_id").groupBy("conv_id", "turn", "window", "other").agg(F.round(F.sum(1 / F.col("n")), 6).alias("score"))
    best = votes.groupBy("conv_id", "turn", "window").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("other"), F.max("score").alias("score"))
    return best.where("score >= 1")


def heard_turns(spark, sf_dir):
    """Turns of which a trigram comes again within two conversations."""
    g = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(text.grams(text.tokens(F.col("text")), 3))).alias("gram"))
    lines = g.withColumn("line", F.concat_ws(":", "conv_id", "turn")).withColumn("at", F.col("conv_id").cast("double"))
    words = g.select("gram", (F.col("conv_id") - 1).cast("double").alias("word_at"))
    return tr.said_within(lines, words, [], "line", "at", "gram", "word_at", 0.5, 2)


def closest_turns(spark, sf_dir):
    """Each turn with its nearest free turn of the next conversation by length, taken in order."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    o = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turn").alias("other"), F.col("n").alias("m"))
    cand = c.join(o, "conv_id").select("conv_id", "turn", "other", F.round(F.least("n", "m") / F.greatest("n", "m"), 6).alias("score"))
    return tr.greedy_pairs(cand, ["conv_id"], "turn", "other", "score", 0.6)


def broken_rows(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("double").alias("at"), F.when(F.col("role") == "user", "U").otherwise("?").alias("speaker"), F.when(F.col("turn") % 2 == 1, F.lower("text")).otherwise(F.regexp_replace("text", r"\.$", "")).alias("text"))
    return tr.joined_broken_rows(c, ["conv_id"], "at", "speaker", "text")


def fitted_clips(spark, sf_dir):
    """Where the first sixteen values of each vector fit the vector itself and the next one."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(nxt, "vec_id").withColumn("own", tr.correlation_udf("e", F.slice("e", 17, 16))).withColumn("next", tr.correlation_udf("f", F.slice("e", 17, 16))).select("vec_id", F.col("own.at").alias("own_at"), F.round("own.r", 6).alias("own_r"), F.col("next.at").alias("next_at"))


def spoken_times(spark, sf_dir):
    """Clock times in texts made of event times, found again."""
    said = F.concat(F.lit("at "), (F.col("event_id") % 300).cast("string"), F.lit(" hours and "), (F.col("event_id") % 60).cast("string"), F.lit(" minutes we go"))
    e = load(spark, sf_dir, "events").select("event_id", tr.said_times_udf(said).alias("s"))
    return e.select("event_id", F.get("s", F.lit(0))["seconds"].alias("seconds"))


QUERIES = {f.__name__: f for f in (after_preamble, stitched_lines, page_streams, agreeing_offsets, best_offsets, backwards_flags, window_votes, heard_turns, closest_turns, broken_rows, fitted_clips, spoken_times)}

TOK = "regexp_extract_all(lower(replace(text, '''', '')), '[a-z0-9]+')"
ORACLE_SQL = {
    "after_preamble": "WITH f AS (SELECT user_id, min(event_id) AS f FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, event_id, event_type FROM events JOIN f USING (user_id) WHERE event_id >= f",
    "stitched_lines": "WITH l AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events) SELECT user_id, CAST(line AS BIGINT) AS line, string_agg(event_type, ' ' ORDER BY event_id) AS event_type, min(event_id) AS event_id FROM l GROUP BY user_id, line",
    "page_streams": """WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS page, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT event_type, page, CASE WHEN n % 5 > 0 THEN substr('AB', n % 2 + 1, 1) END AS letter FROM d),
s AS (SELECT a.event_type, a.page, CASE WHEN (SELECT count(*) FROM p b WHERE b.event_type = a.event_type AND b.page BETWEEN a.page - 2 AND a.page + 2 AND b.letter = a.letter) >= 2 THEN letter END AS sure FROM p a)
SELECT event_type, CAST(page AS INT) AS page, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY page), '') AS stream FROM s""",
    "agreeing_offsets": "WITH o AS (SELECT user_id, event_id, event_id::DOUBLE AS t, event_id + round(value * 10) - event_id AS o FROM events) SELECT a.event_id FROM o a JOIN o b ON a.user_id = b.user_id AND abs(a.o - b.o) <= 1.5 GROUP BY 1 HAVING count(*) >= 2",
    "best_offsets": "WITH e AS (SELECT user_id, round(value, 1) AS o, event_id % 7 AS s FROM events), b AS (SELECT user_id, o AS best, s AS most FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, o) = 1) SELECT user_id, round(median(o), 6) AS \"offset\", count(*) AS n FROM e JOIN b USING (user_id) WHERE abs(o - best) <= 3 GROUP BY user_id, most HAVING count(*) >= 2 OR most >= 5",
    "backwards_flags": "WITH n AS (SELECT user_id, value - lead(value) OVER (PARTITION BY user_id ORDER BY event_id) > 30 AS b FROM events) SELECT user_id, count(*) FILTER (b) >= 3 AS backwards FROM n GROUP BY 1",
    "window_votes": f"""WITH c AS (SELECT conv_id, turn, {TOK} AS w FROM conversations), t AS (SELECT conv_id, turn, k - 1 AS pos, w[k] || ' ' || w[k + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)), o AS (SELECT DISTINCT conv_id AS other, gram FROM t), r AS (SELECT gram, count(*) AS n FROM o GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
q AS (SELECT DISTINCT conv_id, turn, gram, n, unnest([pos // 6, pos // 6 - 1]) AS win FROM t JOIN r USING (gram)), v AS (SELECT conv_id, turn, win, other, round(sum(1.0 / n), 6) AS score FROM q JOIN o USING (gram) WHERE other <> conv_id AND win >= 0 GROUP BY ALL)
SELECT conv_id, turn, CAST(win AS BIGINT) AS "window", other, score FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn, win ORDER BY score DESC, other) = 1 AND score >= 1""",
    "heard_turns": f"""WITH c AS (SELECT conv_id, turn, {TOK} AS w FROM conversations), g AS (SELECT DISTINCT conv_id, turn, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS k FROM c))
SELECT DISTINCT a.conv_id || ':' || a.turn AS line FROM g a JOIN g b USING (gram) WHERE b.conv_id - 1 BETWEEN a.conv_id - 0.5 AND a.conv_id + 2""",
    "spoken_times": "SELECT event_id, event_id % 300 * 3600 + event_id % 60 * 60 AS seconds FROM events",
}
