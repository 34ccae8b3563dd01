"""Photo queries: ranking for a moment, neighbours by frame number, times between anchors, quality.
Parts stand for frames (brand: magazine, key: frame number), orders for dated ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, sequence
from ..sources.tables import load


def moment_photos(spark, sf_dir):
    """Scored 3 for the day itself, 2 within 36 hours, 1 for the kind alone; the others go."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    away = F.abs(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.unix_timestamp(F.lit("1997-06-15 12:00:00").cast("timestamp")))
    score = F.when(away <= 43_200, 3).when(away <= 129_600, 2).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return o.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "o_orderkey").limit(60).select("o_orderkey", "score")


def moment_frames(spark, sf_dir):
    """Dated ones near the moment by price, then the undated by price; twenty-four."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("day"))
    bucket = F.when(F.col("day").isNull(), 1).when(F.abs(F.datediff("day", F.lit("1997-06-15"))) <= 1, 0)
    return o.withColumn("bucket", bucket).where("bucket is not null").orderBy("bucket", F.desc("o_totalprice"), "o_orderkey").limit(24).select("o_orderkey", "bucket")


def neighbour_in_reach(spark, sf_dir):
    """For each part the nearest larger-sized part of its brand by key, within thirty; -1 for none."""
    p = load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    anchors = p.where("p_size >= 40").select("p_brand", F.col("p_partkey").alias("a"), F.col("p_size").alias("s"))
    out = joins.nearest(p.where("p_size < 40"), anchors, ["p_brand"], "p_partkey", "a", ["s"], 1000, tolerance=30)
    return out.select("p_partkey", F.coalesce("match.a", F.lit(-1)).alias("a"))


def frame_times(spark, sf_dir):
    """Times of frames between anchors of their magazine, rounded half to even."""
    p = load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("double").alias("x"), F.when(F.col("p_size") >= 40, F.round(F.col("p_retailprice") * 4)).alias("y"))
    return sequence.interpolate(p, ["p_brand"], "x", "y").select(F.col("x").cast("long").alias("p_partkey"), F.bround("value_at", 2).alias("at"))


def frame_quality(spark, sf_dir):
    """A quality of 0 to 9 from the spread of a vector, 3 where it has none; blank ones marked."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n)
    s = e.withColumn("mean", mean).withColumn("std", spread)
    q = F.least(F.lit(9), F.floor(F.col("std") * 60)).cast("int")
    return s.select("vec_id", F.coalesce(q, F.lit(3)).alias("quality"), F.coalesce((F.col("mean") > 0.05) & (F.col("std") < 0.12), F.lit(False)).alias("blank"))


def frame_keys(spark, sf_dir):
    """Frame names of two spellings to one key; null for other names."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.format_string("AS11-%03d-%05d", F.col("p_size"), F.col("p_partkey"))).when(F.col("p_partkey") % 3 == 1, F.format_string("as11-%d-%d.jpg", F.col("p_size"), F.col("p_partkey"))).otherwise("other").alias("name"))
    return p.select("p_partkey", F.coalesce(text.frame_key(F.col("name")), F.lit("")).alias("key"))


def hour_neighbours(spark, sf_dir):
    """Rows of an hour with those of the hour before and after, counted."""
    h = load(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.count("*").alias("n"))
    shown = h.select(F.explode(F.array(F.col("hour") - 1, F.col("hour"), F.col("hour") + 1)).alias("hour"), "n").groupBy("hour").agg(F.sum("n").alias("shown"))
    return h.join(shown, "hour").select("hour", "n", "shown")


QUERIES = {f.__name__: f for f in (moment_photos, moment_frames, neighbour_in_reach, frame_times, frame_quality, frame_keys, hour_neighbours)}

ORACLE_SQL = {
    "moment_photos": "WITH s AS (SELECT o_orderkey, CASE WHEN abs(epoch(o_orderdate) - epoch(TIMESTAMP '1997-06-15 12:00:00')) <= 43200 THEN 3 WHEN abs(epoch(o_orderdate) - epoch(TIMESTAMP '1997-06-15 12:00:00')) <= 129600 THEN 2 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS score FROM orders) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, o_orderkey LIMIT 60",
    "moment_frames": "WITH s AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN abs(date_diff('day', DATE '1997-06-15', o_orderdate::DATE)) <= 1 THEN 0 END AS bucket FROM orders) SELECT o_orderkey, bucket FROM s WHERE bucket IS NOT NULL ORDER BY bucket, o_totalprice DESC, o_orderkey LIMIT 24",
    "neighbour_in_reach": "WITH a AS (SELECT p_brand, p_partkey AS a FROM part WHERE p_size >= 40) SELECT p_partkey, coalesce((SELECT arg_min(a, abs(a - p_partkey) * 2 + (a > p_partkey)::INT) FROM a WHERE a.p_brand = p.p_brand AND abs(a - p_partkey) <= 30), -1) AS a FROM part p WHERE p_size < 40",
    "frame_times": """WITH v AS (SELECT p_brand, p_partkey AS k, round(p_retailprice * 4) AS y FROM part WHERE p_size >= 40), b AS (SELECT p.*, v.k AS x0, v.y AS y0 FROM part p ASOF LEFT JOIN v ON p.p_brand = v.p_brand AND p.p_partkey >= v.k), c AS (SELECT b.*, v.k AS x1, v.y AS y1 FROM b ASOF LEFT JOIN v ON b.p_brand = v.p_brand AND b.p_partkey <= v.k)
SELECT p_partkey, round_even(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (p_partkey - x0)::DOUBLE / (x1 - x0) END, 2) AS at FROM c""",
    "frame_quality": "WITH s AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS mean, list_stddev_pop(embedding::DOUBLE[]) AS std FROM embeddings) SELECT vec_id, CAST(least(9, floor(std * 60)) AS INT) AS quality, mean > 0.05 AND std < 0.12 AS blank FROM s",
    "frame_keys": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '11-' || p_size || '-' || p_partkey ELSE '' END AS key FROM part",
    "hour_neighbours": "WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1) SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS shown FROM h",
}
