"""Relational basics on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates, joins
from ..sources.tables import load


def conditional_sum_join(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("quantity"))


def top_reactions(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    by_flag = l.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    flags = F.array_join(F.transform(F.array_sort(F.collect_list("l_returnflag")), lambda x: x), " ")
    top = by_flag.groupBy("l_partkey").agg(F.sum("n").alias("total"), flags.alias("flags"))
    # Every line has its part, so the top thirty are taken before the join.
    top = top.orderBy(F.desc("total"), "l_partkey").limit(30)
    return top.join(p, F.col("l_partkey") == F.col("p_partkey")).orderBy(F.desc("total"), "p_partkey").select("p_partkey", "p_name", "p_brand", "total", "flags")


def top_prefix(spark, sf_dir):
    p = load(spark, sf_dir, "part").where(F.upper("p_name").startswith("RED")).select("p_partkey", "p_name")
    l = load(spark, sf_dir, "lineitem").select("l_partkey")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_partkey").limit(200)


def with_status(orders: DataFrame, status: str) -> DataFrame:
    """Rows of a status, or all of them for 'all'."""
    return orders if status == "all" else orders.where(F.col("o_orderstatus") == status)


def optional_status(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    one = with_status(o, "P").orderBy(F.desc("o_orderkey")).limit(500).withColumn("asked", F.lit("P"))
    return one.unionByName(with_status(o, "all").orderBy(F.desc("o_orderkey")).limit(500).withColumn("asked", F.lit("all")))


def counts_of_ids(spark, sf_dir):
    """Counts for a list of keys, zero included, and the caller's own among them."""
    ids = load(spark, sf_dir, "part").where("p_size = 7").select("p_partkey")
    l = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    n = l.join(ids, F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_suppkey") == 3).alias("mine"))
    return ids.join(n, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mine", F.lit(0)).alias("mine"))


def not_yet_labelled(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def semi_labelled(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


def override_lookup(spark, sf_dir):
    """Rejected keys go, an override wins over the own value, a flag tells who has one."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rejected = load(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    over = load(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("_over"))
    return o.join(rejected, "o_orderkey", "left_anti").join(over, "o_custkey", "left").select("o_orderkey", F.coalesce("_over", "o_orderpriority").alias("kind"), F.col("_over").isNotNull().alias("refiled"))


def other_nations(spark, sf_dir):
    """Each nation with the others of its region."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("_r"))
    return n.join(m, F.col("n_regionkey") == F.col("_r")).where("n_nationkey <> other").groupBy("n_nationkey", "n_name").agg(F.count("*").alias("others"))


def set_operations(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    u = lambda kind: e.where(F.col("event_type") == kind).select("user_id").distinct()
    tag = lambda df, what: df.withColumn("what", F.lit(what))
    a, b = e.where("value > 60 and event_type = 'view'").select("user_id"), e.where("value > 60 and event_type = 'error'").select("user_id")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "both")).unionByName(tag(a.subtract(b), "only views")).unionByName(tag(u("signup").subtract(a), "signups without"))


def paged(spark, sf_dir):
    """The third page of sixty rows."""
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(120).limit(60)


def nulls_last(spark, sf_dir):
    """By a date that may be missing, missing ones last."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return o.orderBy(F.asc_nulls_last("day"), "o_orderkey")


def snapshot_diff(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))).unionByName(o.where("o_orderkey < 20").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    return joins.snapshot_diff(o, new, "o_orderkey", "o_orderstatus")


def preferred_sources(spark, sf_dir):
    """Three ranked sources; a key of an earlier one is not taken again; twenty of each group."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    src = lambda cond, rank: p.where(cond).withColumn("rank", F.lit(rank))
    all_ = src("p_size > 45", 1).unionByName(src("p_type = 'SMALL'", 2)).unionByName(src("p_retailprice > 1000", 3))
    first = all_.groupBy("p_partkey", "p_brand", "p_retailprice").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("rank", F.desc("p_retailprice"), "p_partkey"))
    return first.withColumn("place", place.cast("long")).where("place <= 20")


def reviewer_queue(spark, sf_dir):
    """A person's last five marks, then everything still to do without those."""
    l = load(spark, sf_dir, "labels")
    mine = l.where("quality = 0").orderBy(F.desc("doc_id")).limit(5).select("doc_id", F.lit(0).alias("part"))
    rest = load(spark, sf_dir, "documents").select("doc_id").join(l.where("quality = 1"), "doc_id", "left_anti").join(mine, "doc_id", "left_anti").select("doc_id", F.lit(1).alias("part"))
    return mine.unionByName(rest)


def mode_impute(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang").withColumn("known", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    modes = aggregates.mode_first_seen(d, ["source"], "known", "doc_id")
    return d.join(modes, "source").select("doc_id", F.coalesce("known", "mode").alias("lang"))


def linear_fit(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    fit = aggregates.clipped_fit(l, ["l_returnflag", "l_linestatus"], "l_quantity", "l_tax", 10, 0.0001)
    return fit.select("l_returnflag", "l_linestatus", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


def agreement(spark, sf_dir):
    """Banded counts, shares over judged rows only."""
    l = load(spark, sf_dir, "lineitem")
    share = F.col("l_quantity") / 50
    judged = F.when(F.col("l_linenumber") < 5, (F.col("l_returnflag") == "A").cast("int"))
    return l.groupBy("l_linestatus").agg(
        F.count_if(share >= 0.9).alias("strong"), F.count_if((share >= 0.6) & (share < 0.9)).alias("middling"), F.count_if(share < 0.6).alias("weak"),
        F.round(100 * F.avg(judged), 1).alias("agreed"), F.count_if(F.col("l_linenumber").isNull()).alias("none"),
    )


def background_level(spark, sf_dir):
    """The tenth percentile, interpolated."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.1)), 1).alias("level"), F.round(F.median("value"), 4).alias("median"))


def chapter_votes(spark, sf_dir):
    """Per order: major if any line is, rest if a third or more are, else routine."""
    l = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_quantity") >= 49).alias("any"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return l.select("l_orderkey", F.when(F.col("any"), "major").when(F.col("r") * 3 >= F.col("n"), "rest").otherwise("routine").alias("kind"))


def strong_matches(spark, sf_dir):
    """Lines of much quantity, without parts that have such lines from three suppliers or more."""
    l = load(spark, sf_dir, "lineitem").where("l_quantity >= 40").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    wide = l.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n >= 3")
    return l.join(wide, "l_partkey", "left_anti").where("l_quantity >= 43").select("l_orderkey", "l_linenumber", "l_partkey")


def json_column(spark, sf_dir):
    """A JSON column read into a typed field; bodies that are not objects give null."""
    e = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>").alias("j"))
    return e.groupBy((F.col("j.k") % 10).alias("k")).agg(F.count("*").alias("n"), F.max("j.k").alias("most"))


def maps_of_rows(spark, sf_dir):
    """Rows folded into a map by key, unfolded and filtered again."""
    m = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    kept = m.select("n_regionkey", F.map_filter("m", lambda k, v: v % 2 == 0).alias("m"))
    return kept.select("n_regionkey", F.explode("m").alias("n_name", "n_nationkey"))


QUERIES = {f.__name__: f for f in (
    conditional_sum_join, top_reactions, top_prefix, optional_status, counts_of_ids, not_yet_labelled, semi_labelled, override_lookup, other_nations, set_operations, paged, nulls_last, snapshot_diff,
    preferred_sources, reviewer_queue, mode_impute, linear_fit, agreement, background_level, chapter_votes, strong_matches, json_column, maps_of_rows,
)}

ORACLE_SQL = {
    "conditional_sum_join": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1",
    "top_reactions": "SELECT p_partkey, p_name, p_brand, count(*) AS total, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS flags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL ORDER BY total DESC, p_partkey LIMIT 30",
    "top_prefix": "SELECT p_partkey, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE upper(p_name) LIKE 'RED%' GROUP BY ALL ORDER BY n DESC, p_partkey LIMIT 200",
    "optional_status": "(SELECT o_orderkey, o_orderstatus, o_totalprice, 'P' AS asked FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 500) UNION ALL (SELECT o_orderkey, o_orderstatus, o_totalprice, 'all' FROM orders ORDER BY o_orderkey DESC LIMIT 500)",
    "counts_of_ids": "SELECT p_partkey, count(l_partkey) AS n, count(*) FILTER (l_suppkey = 3) AS mine FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY 1",
    "not_yet_labelled": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_labelled": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "override_lookup": "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS kind, c_custkey IS NOT NULL AS refiled FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 9000 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)",
    "other_nations": "SELECT a.n_nationkey, a.n_name, count(*) AS others FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL",
    "set_operations": "WITH a AS (SELECT user_id FROM events WHERE value > 60 AND event_type = 'view'), b AS (SELECT user_id FROM events WHERE value > 60 AND event_type = 'error') SELECT user_id, 'union' AS what FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT user_id, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'only views' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, 'signups without' FROM (SELECT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT * FROM a)",
    "paged": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 120",
    "nulls_last": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders ORDER BY day ASC NULLS LAST, o_orderkey",
    "snapshot_diff": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'modified' END AS change FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 11 = 0 AND o_orderstatus <> 'X') UNION ALL SELECT o_orderkey + 10000000, 'added' FROM orders WHERE o_orderkey < 20",
    "preferred_sources": "WITH s AS (SELECT p_partkey, p_brand, p_retailprice, CASE WHEN p_size > 45 THEN 1 WHEN p_type = 'SMALL' THEN 2 WHEN p_retailprice > 1000 THEN 3 END AS rank FROM part) SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rank, p_retailprice DESC, p_partkey) AS place FROM s WHERE rank IS NOT NULL QUALIFY place <= 20",
    "reviewer_queue": "WITH m AS (SELECT doc_id FROM labels WHERE quality = 0 ORDER BY doc_id DESC LIMIT 5) SELECT doc_id, 0 AS part FROM m UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM m)",
    "mode_impute": "WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 4 <> 0 THEN lang END AS known FROM documents), m AS (SELECT source, arg_max(known, n * 1000000000 - f) AS mode FROM (SELECT source, known, count(*) AS n, min(doc_id) AS f FROM d WHERE known IS NOT NULL GROUP BY ALL) GROUP BY 1) SELECT doc_id, coalesce(known, mode) AS lang FROM d JOIN m USING (source)",
    "linear_fit": "WITH f AS (SELECT l_returnflag, l_linestatus, CASE WHEN max(l_quantity) - min(l_quantity) > 10 THEN greatest(least(regr_slope(l_tax, l_quantity), 0.0001), -0.0001) ELSE 0 END AS s FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(s, 8) AS slope, round(median(l_tax - s * l_quantity), 6) AS intercept, count(*) AS n FROM lineitem JOIN f USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus, s",
    "agreement": "SELECT l_linestatus, count(*) FILTER (l_quantity / 50 >= 0.9) AS strong, count(*) FILTER (l_quantity / 50 >= 0.6 AND l_quantity / 50 < 0.9) AS middling, count(*) FILTER (l_quantity / 50 < 0.6) AS weak, round(100 * avg(CASE WHEN l_linenumber < 5 THEN (l_returnflag = 'A')::INT END), 1) AS agreed, count(*) FILTER (l_linenumber IS NULL) AS \"none\" FROM lineitem GROUP BY 1",
    "background_level": "SELECT event_type, round(quantile_cont(value, 0.1), 1) AS level, round(median(value), 4) AS median FROM events GROUP BY 1",
    "chapter_votes": "SELECT l_orderkey, CASE WHEN max(l_quantity) >= 49 THEN 'major' WHEN count(*) FILTER (l_returnflag = 'R') * 3 >= count(*) THEN 'rest' ELSE 'routine' END AS kind FROM lineitem GROUP BY 1",
    "strong_matches": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 43 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40 GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3)",
    "json_column": "SELECT (props->>'k')::BIGINT % 10 AS k, count(*) AS n, max((props->>'k')::BIGINT) AS most FROM events GROUP BY 1",
    "maps_of_rows": "SELECT n_regionkey, n_name, n_nationkey FROM nation WHERE n_nationkey % 2 = 0",
}
