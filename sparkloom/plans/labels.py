"""Labels, codes, file names and printed times over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, labels
from ..operators import writes
from ..sources.tables import load


def unclear_marks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", labels.unclear_marked(F.col("text")).alias("marked"))
    return d.where("marked <> text").select("doc_id", F.md5("marked").alias("digest"))


def spoken_notes(spark, sf_dir):
    noted = F.concat(F.lit(" [a note] "), F.col("text"), F.lit("\n[open"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(labels.spoken(noted)).alias("digest"))


LABELS = ["Duke (LM onboard)", "Mitchell-LM", "Bean/Conrad", "Cernan (Backup) :", "Young (onboard)", " SC ", "Roosa, Stu", ""]


def _one_of(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def speaker_labels(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", _one_of(LABELS, "c_custkey").alias("label"))
    c = c.withColumn("s", labels.speaker_and_channel(F.col("label")))
    return c.select("c_custkey", labels.bare_name(F.col("label")).alias("name"), F.col("s.speaker").alias("speaker"), F.col("s.channel").alias("channel"))


CODES = ["CC", "CDR", "CMP", "LMP", "SC", "MS", "SWIM"]
TOKENS = ["CDR-LM", "SC-CM", "CDR-I24", "CC", "XQZJWVK", "lmp", "C0R", ""]


def nearest_codes(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", labels.nearest_code(_one_of(TOKENS, "p_partkey"), CODES).alias("code"))


def printed_clocks(spark, sf_dir):
    """Times printed with misread digits; some smudged, some without minutes, some impossible."""
    g = F.col("o_orderkey") % 400_000
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    d, h, m, s = part(g / 86_400), part(g / 3600 % 24), part(g / 60 % 60), part(g % 60)
    hazy = F.translate(F.concat_ws(" ", d, h, m, s), "015", "OlS")
    o = load(spark, sf_dir, "orders").select("o_orderkey", hazy.alias("whole"), F.concat_ws(" ", d, h, m, F.concat(F.lit("_"), F.right(s, F.lit(1)))).alias("smudged"), F.concat_ws(" ", d, h, F.lit("-- --")).alias("hour"), F.concat_ws(" ", d, F.lit("31"), m, s).alias("bad"))
    c = F.col
    return o.select("o_orderkey", labels.printed_clock(c("whole")).cast("long").alias("at"), labels.smudged_clock(c("smudged")).alias("pattern"), labels.printed_hour(c("hour")).cast("long").alias("hour"), labels.printed_clock(c("bad")).cast("long").alias("bad"))


def file_clocks(spark, sf_dir):
    k = F.lpad((F.col("o_orderkey") % 10_000_000).cast("string"), 7, "0")
    split = F.concat(F.substring(k, 1, 3), F.lit("_"), F.substring(k, 4, 2), F.lit("_"), F.substring(k, 6, 2))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("http://x.org/a12a_"), split, F.lit(".mp3"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("a/a15."), k, F.lit(".mp3"))).otherwise(F.concat(F.lit("a12_t-"), split))
    return load(spark, sf_dir, "orders").select("o_orderkey", labels.file_clock(name).alias("clock"))


def caption_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "d MMM")
    text = F.concat(F.lit("Seen from afar ("), F.when(F.col("o_orderkey") % 3 == 0, "1-").otherwise(""), day, F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise(""), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(") by all"))
    return load(spark, sf_dir, "orders").select("o_orderkey", labels.caption_date(text).alias("day"))


def disc_places(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3 - 75).cast("double").alias("lat"), (F.col("p_retailprice") % 180 - 90).alias("lon"))
    at = labels.disc_place(F.col("lat"), F.col("lon"))
    return p.select("p_partkey", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), labels.coordinates(F.col("lat"), F.lit(-12.5)).alias("place"))


def sentence_ends(spark, sf_dir):
    w = load(spark, sf_dir, "conversations").select(F.explode(F.split(F.concat("text", F.lit(" Dr. B. A. vs. end?")), " ")).alias("word"))
    return w.groupBy(labels.ends_sentence(F.col("word")).alias("ends")).agg(F.count("*").alias("n"))


def clip_channels(spark, sf_dir):
    name = F.concat(F.lit("a"), F.col("p_partkey").cast("string"), _one_of(["-PAO", "_ob1", "ob.mp3", "job", "obs", ""], "p_partkey"))
    return load(spark, sf_dir, "part").groupBy(labels.clip_channel(name).alias("channel")).agg(F.count("*").alias("n"))


def minutes_heard(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.hour("ts").cast("long").alias("hour"), "value")
    m = writes.whole_units(e, ["user_id", "hour"], F.round("value").cast("long"), 60)
    return m.select("user_id", "hour", F.col("sent").cast("long").alias("sent"), F.col("left").cast("long").alias("left"))


def sync_lists(spark, sf_dir):
    l = load(spark, sf_dir, "labels")
    return writes.sync_lists(load(spark, sf_dir, "documents"), l.where("toxic = 0"), l.where("quality = 0"), "doc_id")


def batch_to_do(spark, sf_dir):
    return writes.to_do(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), ["doc_id"])


# Events of four made-up flights: one that lands, one around the Earth, one that swings by, one that orbits.
FLIGHTS = [
    {"flight": 0, "tli": 10_000, "loi": 270_000, "landing": 370_000, "liftoff": 450_000, "lm_jettison": 470_000, "tei": 490_000, "cm_sep": 690_000},
    {"flight": 1, "docking": 12_000, "eva_start": 200_000, "eva_end": 210_000, "undocking": 300_000, "redocking": 320_000, "lm_jettison": 400_000, "cm_sep": 650_000},
    {"flight": 2, "tli": 9_000, "pericynthion": 280_000, "cm_sep": 500_000},
    {"flight": 3, "tli": 9_000, "loi": 270_000, "undocking": 350_000, "redocking": 380_000, "tei": 490_000, "cm_sep": 690_000},
]
EVENTS = ["tli", "loi", "pericynthion", "landing", "liftoff", "lm_jettison", "undocking", "redocking", "tei", "docking", "eva_start", "eva_end", "cm_sep"]


def flight_stages(spark, sf_dir):
    """The stage of a flight at each event's time."""
    flights = spark.createDataFrame([[f.get(k) for k in ("flight", *EVENTS)] for f in FLIGHTS], ", ".join(f"{k} long" for k in ("flight", *EVENTS)))
    e = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).cast("long").alias("flight"), (F.col("event_id") * 7919 % 700_000).alias("g"))
    on = e.join(F.broadcast(flights), "flight")  # four rows
    return on.select("event_id", clock.stage_at(F.col("g"), clock.flight_stages(F.col), "splashdown").alias("stage"))


def anniversaries(spark, sf_dir):
    """Events in a year's days after the anniversary of a launch, leap days among the launches."""
    at = F.make_timestamp(F.lit(1968), F.col("event_id") % 12 + 1, F.col("event_id") % 29 + 1, F.col("event_id") % 24, F.lit(30), F.lit(15))
    e = load(spark, sf_dir, "events").select("event_id", "ts", at.alias("launch"), (F.col("event_id") % 40 * 86_400).cast("long").alias("lasts"))
    a = e.withColumn("a", clock.anniversary(F.col("launch"), F.col("lasts"), F.col("ts")))
    return a.where("a is not null").select("event_id", F.col("a.seconds").alias("seconds"), F.col("a.years").cast("long").alias("years"))


NAMES = ["Houston", "Canary", "Madrid", "Tananarive", "Carnarvon"]
MISREAD = ["Hous_on", "tlouston", "}:ouston", "houston", "C_n_ry", "Madr", "Mars", "Tar_n_ri_e", "Carnarvnn", ""]


def damaged_names(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", labels.damaged_name_udf(NAMES)(_one_of(MISREAD, "p_partkey")).alias("name"))


QUERIES = {f.__name__: f for f in (unclear_marks, spoken_notes, speaker_labels, nearest_codes, printed_clocks, file_clocks, caption_dates, disc_places, sentence_ends, clip_channels, minutes_heard, sync_lists, batch_to_do, flight_stages, anniversaries, damaged_names)}

ORACLE_SQL = {
    "unclear_marks": r"WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\s*(?:\.\s?){3}(\.?)|\s*\*{3}', ' [unclear]\1', 'g'), '^ ', ''), '\[unclear\](\w)', '[unclear] \1', 'g') AS marked FROM documents) SELECT doc_id, md5(marked) AS digest FROM m WHERE marked <> text",
    "spoken_notes": r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM conversations",
    "speaker_labels": "WITH v(k, name, speaker, channel) AS (VALUES (0, 'duke', 'Duke (LM onboard)', 'air-to-ground'), (1, 'mitchell', 'Mitchell-LM', 'air-to-ground'), (2, 'bean', 'Bean/Conrad', 'air-to-ground'), (3, 'cernan  :', 'Cernan (Backup)', 'air-to-ground'), (4, 'young', 'Young', 'onboard'), (5, 'sc', 'SC', 'air-to-ground'), (6, 'roosa', 'Roosa, Stu', 'air-to-ground'), (7, '', '', 'air-to-ground')) SELECT c_custkey, name, speaker, channel FROM customer JOIN v ON c_custkey % 8 = k",
    "nearest_codes": "WITH v(k, code) AS (VALUES (0, 'CDR'), (1, 'SC'), (2, 'CDR'), (3, 'CC'), (4, '?'), (5, 'LMP'), (6, 'CDR'), (7, '?')) SELECT p_partkey, code FROM part JOIN v ON p_partkey % 8 = k",
    "printed_clocks": "WITH g AS (SELECT o_orderkey, o_orderkey % 400000 AS g FROM orders) SELECT o_orderkey, g AS at, printf('%02d%02d%02d', g // 86400, g // 3600 % 24, g // 60 % 60) || '?' || (g % 10) AS pattern, g // 3600 * 3600 AS hour, CAST(NULL AS BIGINT) AS bad FROM g",
    "file_clocks": "WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS k FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN k[1:3] || ':' || k[4:5] || ':' || k[6:7] END AS clock FROM k",
    "caption_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "disc_places": "WITH p AS (SELECT p_partkey, (p_size * 3 - 75)::DOUBLE AS lat, p_retailprice % 180 - 90 AS lon FROM part) SELECT p_partkey, round(50 + 50 * cos(radians(lat)) * sin(radians(lon)), 6) AS x, round(50 - 50 * sin(radians(lat)), 6) AS y, printf('%.3f°', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', 12.500°W' AS place FROM p",
    "sentence_ends": r"WITH w AS (SELECT unnest(string_split(text || ' Dr. B. A. vs. end?', ' ')) AS word FROM conversations) SELECT regexp_matches(trim(word), '[.?!]$') AND NOT regexp_full_match(trim(word), '(?:Dr|Mr|Mrs|Ms|St|Jr|Sr|Gen|Col|Lt|Capt|Gov|Sen|Rep|vs|[B-HJ-Z])\.') AS ends, count(*) AS n FROM w GROUP BY 1",
    "clip_channels": "SELECT CASE WHEN p_partkey % 6 = 0 THEN 'broadcast' WHEN p_partkey % 6 IN (1, 2, 3) THEN 'onboard' ELSE 'air-to-ground' END AS channel, count(*) AS n FROM part GROUP BY 1",
    "minutes_heard": "WITH m AS (SELECT user_id, hour(ts) AS hour, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY ALL) SELECT user_id, hour, s // 60 AS sent, s % 60 AS left FROM m",
    "flight_stages": """WITH s(flight, a, z, stage) AS (VALUES (0, 690, 10000, 'earth-orbit'), (0, 10000, 270000, 'transit-to-moon'), (0, 270000, 369220, 'lunar-orbit'), (0, 369220, 370060, 'landing'), (0, 370060, 450000, 'surface'), (0, 450000, 470000, 'ascent'), (0, 470000, 490000, 'lunar-orbit'), (0, 490000, 690000, 'transit-to-earth'),
(1, 690, 12000, 'earth-orbit'), (1, 12000, 200000, 'earth-orbit-docked'), (1, 200000, 210000, 'spacewalk'), (1, 210000, 300000, 'earth-orbit-docked'), (1, 300000, 320000, 'lm-solo'), (1, 320000, 400000, 'earth-orbit-docked'), (1, 400000, 650000, 'earth-orbit'),
(2, 690, 9000, 'earth-orbit'), (2, 9000, 280000, 'transit-to-moon'), (2, 280000, 500000, 'transit-to-earth'),
(3, 690, 9000, 'earth-orbit'), (3, 9000, 270000, 'transit-to-moon'), (3, 270000, 350000, 'lunar-orbit'), (3, 350000, 380000, 'lm-solo'), (3, 380000, 490000, 'lunar-orbit'), (3, 490000, 690000, 'transit-to-earth')),
e AS (SELECT event_id, event_id % 4 AS flight, event_id * 7919 % 700000 AS g FROM events) SELECT event_id, CASE WHEN g < 690 THEN 'launch' ELSE coalesce(stage, 'splashdown') END AS stage FROM e LEFT JOIN s ON e.flight = s.flight AND g >= a AND g < z""",
    "anniversaries": "WITH e AS (SELECT event_id, ts, make_date(year(ts), event_id % 12 + 1, 1)::TIMESTAMP + to_days(CAST(event_id % 29 AS INT)) + to_hours(event_id % 24) + INTERVAL 1815 SECONDS AS a, event_id % 40 * 86400 AS lasts FROM events), s AS (SELECT event_id, year(ts) - 1968 AS years, CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(a) AS BIGINT) AS seconds, lasts FROM e) SELECT event_id, seconds, years FROM s WHERE lasts > 0 AND seconds BETWEEN 0 AND lasts",
    "damaged_names": "WITH v(k, name) AS (VALUES (0, 'Houston'), (1, 'Houston'), (2, 'Houston'), (4, 'Canary'), (5, 'Madrid'), (7, 'Tananarive'), (8, 'Carnarvon')) SELECT p_partkey, name FROM part LEFT JOIN v ON p_partkey % 10 = k",
    "sync_lists": "SELECT doc_id, 'upload' AS action FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) UNION ALL SELECT DISTINCT doc_id, 'delete' FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "batch_to_do": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
