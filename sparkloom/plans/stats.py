"""Daily counters: the read path of event statistics, and the write path as state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text, web
from ..operators import sequence, writes
from ..sources.tables import load


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def stats_daily_kind(spark, sf_dir):
    return events(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-08 00:00:00'").groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stats_daily_visitors(spark, sf_dir):
    return events(spark, sf_dir).groupBy("day").agg(F.countDistinct("user_id").alias("visitors"))


def stats_days_filled(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return sequence.filled(e, "day", ["event_type"], "n", "2023-12-30", "2024-02-02")


def stats_hour_of_day(spark, sf_dir):
    return events(spark, sf_dir).groupBy(clock.hour_shifted(F.hour("ts"), -5).cast("long").alias("hour")).agg(F.count("*").alias("n"))


def stats_tiles(spark, sf_dir):
    e = events(spark, sf_dir)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    totals = e.agg(F.count("*").alias("n"), n("view").alias("views"), n("error").alias("errors"))
    days = e.select("day", "user_id").distinct().agg(F.count("*").alias("visitor_days"))
    return totals.crossJoin(days).withColumn("error_share", F.when(F.col("n") == 0, 0).otherwise(F.floor(100 * F.col("errors") / F.col("n") + 0.5)).cast("long"))


def stats_top_kinds(spark, sf_dir):
    """Twelve users with the most events; width: share of the most, two per cent at least."""
    top = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(12)
    most = top.agg(F.max("n").alias("most"))
    return top.crossJoin(most).select("user_id", "n", F.greatest(F.lit(2), F.floor(100 * F.col("n") / F.col("most") + 0.5)).cast("long").alias("width"))


def stats_rollup(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


#: Kinds that are counted; others are dropped.
KINDS = ["view", "click", "purchase", "signup"]


def cleaned(e: DataFrame) -> DataFrame:
    """kind by a list, item cut to four characters, n rounded half up and kept within 1..120."""
    n = F.greatest(F.lit(1), F.least(F.lit(120), F.floor(F.coalesce(F.col("value"), F.lit(1.0)) + 0.5))).cast("long")
    return e.where(F.col("event_type").isin(*KINDS)).select("day", "ts", "user_id", F.col("event_type").alias("kind"), F.substring(F.col("user_id").cast("string"), 1, 4).alias("item"), n.alias("n"))


def fanned_out(c: DataFrame) -> DataFrame:
    """Counter rows of each event: itself, and for a signup its hour as well."""
    own = F.struct("kind", "item", "n")
    hour = F.struct(F.lit("hour").alias("kind"), F.hour("ts").cast("string").alias("item"), F.lit(1).cast("long").alias("n"))
    rows = F.when(F.col("kind") == "signup", F.array(own, hour)).otherwise(F.array(own))
    return c.select("day", F.explode(rows).alias("r")).select("day", "r.*")


def event_counters(spark, sf_dir):
    changes = fanned_out(cleaned(events(spark, sf_dir)))
    state = changes.where("day < '2024-01-15'").groupBy("day", "kind", "item").agg(F.sum("n").alias("n"))
    return writes.upsert_add(state, changes.where("day >= '2024-01-15'"), ["day", "kind", "item"], "n")


def first_write_wins(spark, sf_dir):
    return writes.first_write_wins(events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


def last_write_wins(spark, sf_dir):
    return writes.last_write_wins(events(spark, sf_dir).select("user_id", "event_id", "event_type", "props"), ["user_id"], F.col("event_id"))


def insert_missing(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "day").distinct()
    return writes.insert_missing(e.where("day < '2024-01-10'"), e.where("day >= '2024-01-08' and day < '2024-01-12'"), ["user_id", "day"])


def change_feed(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_orderkey") % 10 == 0).alias("gone"))
    return writes.apply_changes(o, changes, "o_orderkey", "gone")


def status_update(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return writes.set_where(o, (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1"), o_orderstatus=F.lit("F"))


def toggled(spark, sf_dir):
    return writes.toggled(events(spark, sf_dir).where("event_type in ('click', 'error')"), ["user_id", "day"], F.col("event_type") == "click", F.col("event_id"))


def rate_limited(spark, sf_dir):
    return writes.under_limit(events(spark, sf_dir), ["day", "event_type", "user_id"], 1, F.col("event_id")).select("day", "event_type", "user_id", "event_id")


def daily_hash(spark, sf_dir):
    """Distinct visitors by a hash salted with the day, and their count by its first digit."""
    e = events(spark, sf_dir).select("day", text.salted("salt", F.col("day"), F.col("user_id").cast("string")).alias("visitor")).distinct()
    return e.groupBy(F.substring("visitor", 1, 1).alias("digit")).agg(F.count("*").alias("n"), F.min("visitor").alias("first"))


AGENTS = [
    "Mozilla/5.0 (X11; Linux) AppleWebKit Chrome/120 Safari/537", "Mozilla/5.0 (iPhone) Mobile Safari/604", "Mozilla/5.0 (iPad) Safari/604",
    "Mozilla/5.0 (compatible; Examplebot/2.1)", "", "curl/8.1", "Mozilla/5.0 (Windows) Firefox/121", "Mozilla/5.0 Chrome/120 Safari/537 Edg/120",
]


def visit_classes(spark, sf_dir):
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("user_id") % len(AGENTS) + 1).cast("int"))
    e = events(spark, sf_dir).select(agent.alias("agent"))
    a = F.col("agent")
    kind = F.coalesce(F.concat(F.lit("bot: "), web.crawler(a)), F.lit("browser"))
    return e.groupBy(kind.alias("kind"), web.device(a).alias("device"), web.browser(a).alias("browser")).agg(F.count("*").alias("n"))


def host_source(spark, sf_dir):
    h = web.host(F.col("url"))
    odd = F.element_at(F.array(*map(F.lit, ["www.google.com", "m.facebook.com", "", "x.com", "news.example.com"])), (F.col("page_id") % 5 + 1).cast("int"))
    p = load(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, h).otherwise(odd).alias("h"))
    return p.select("page_id", web.referrer(F.col("h"), ["example.org"]).alias("source"))


QUERIES = {f.__name__: f for f in (
    stats_daily_kind, stats_daily_visitors, stats_days_filled, stats_hour_of_day, stats_tiles, stats_top_kinds, stats_rollup, event_counters, first_write_wins,
    last_write_wins, insert_missing, change_feed, status_update, toggled, rate_limited, daily_hash, visit_classes, host_source,
)}

E = "e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)"
ORACLE_SQL = {
    "stats_daily_kind": f"WITH {E} SELECT day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e WHERE day >= '2024-01-08' GROUP BY ALL",
    "stats_daily_visitors": f"WITH {E} SELECT day, count(DISTINCT user_id) AS visitors FROM e GROUP BY day",
    "stats_days_filled": f"WITH {E} SELECT strftime(d, '%Y-%m-%d') AS day, 'purchase' AS event_type, (SELECT count(*) FROM e WHERE e.day = strftime(d, '%Y-%m-%d') AND event_type = 'purchase') AS n FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) AS s(d)",
    "stats_hour_of_day": "SELECT (hour(ts) + 19) % 24 AS hour, count(*) AS n FROM events GROUP BY 1",
    "stats_tiles": f"WITH {E} SELECT count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT (day, user_id)) AS visitor_days, CAST(floor(100.0 * count(*) FILTER (event_type = 'error') / count(*) + 0.5) AS BIGINT) AS error_share FROM e",
    "stats_top_kinds": "WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 12) SELECT user_id, n, CAST(greatest(2, floor(100.0 * n / max(n) OVER () + 0.5)) AS BIGINT) AS width FROM t",
    "stats_rollup": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(c_mktsegment, o_orderpriority) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)",
    "event_counters": f"WITH {E}, c AS (SELECT day, event_type AS kind, left(CAST(user_id AS VARCHAR), 4) AS item, CAST(greatest(1, least(120, floor(coalesce(value, 1) + 0.5))) AS BIGINT) AS n, hour(ts) AS h FROM e WHERE event_type IN ('view', 'click', 'purchase', 'signup')), r AS (SELECT day, kind, item, n FROM c UNION ALL SELECT day, 'hour', CAST(h AS VARCHAR), 1 FROM c WHERE kind = 'signup') SELECT day, kind, item, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL",
    "first_write_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "last_write_wins": "SELECT user_id, event_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "insert_missing": f"WITH {E} SELECT DISTINCT user_id, day FROM e WHERE day < '2024-01-12'",
    "change_feed": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0",
    "status_update": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND starts_with(o_orderpriority, '1') THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders",
    "toggled": f"WITH {E} SELECT user_id, day FROM e WHERE event_type IN ('click', 'error') GROUP BY ALL HAVING arg_max(event_type, event_id) = 'click'",
    "rate_limited": f"WITH {E} SELECT day, event_type, user_id, min(event_id) AS event_id FROM e GROUP BY ALL",
    "daily_hash": f"WITH {E}, v AS (SELECT DISTINCT day, left(sha256('salt|' || day || '|' || user_id), 24) AS visitor FROM e) SELECT left(visitor, 1) AS digit, count(*) AS n, min(visitor) AS first FROM v GROUP BY 1",
    "visit_classes": """WITH k AS (SELECT user_id % 8 AS k FROM events) SELECT CASE k WHEN 3 THEN 'bot: examplebot' WHEN 4 THEN 'bot: no user agent' WHEN 5 THEN 'bot: curl' ELSE 'browser' END AS kind,
  CASE k WHEN 1 THEN 'phone' WHEN 2 THEN 'tablet' ELSE 'computer' END AS device, CASE k WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Safari' WHEN 6 THEN 'Firefox' WHEN 7 THEN 'Edge' ELSE 'other' END AS browser, count(*) AS n FROM k GROUP BY ALL""",
    "host_source": """WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) ELSE ['www.google.com', 'm.facebook.com', '', 'x.com', 'news.example.com'][page_id % 5 + 1] END AS h FROM pages)
SELECT page_id, CASE WHEN h = '' THEN 'direct' WHEN contains(h, 'example.org') THEN '' WHEN h = 'www.google.com' THEN 'search:google' WHEN h IN ('m.facebook.com', 'x.com') THEN 'social:' || h ELSE 'link:' || regexp_replace(h, '^www\\.', '') END AS source FROM h""".replace("\\\\", "\\"),
}
