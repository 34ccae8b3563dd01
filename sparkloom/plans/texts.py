"""Text queries: vocabularies, votes, pages, identifiers, search; greedy folds and alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import align, text, web
from ..operators import aggregates, folds, joins, runs
from ..sources import html, scratch
from ..sources.tables import load
from ..streaming import counters


def token_vocab(spark, sf_dir):
    """Words by how often they occur: kept from two on, common from five on, spoken from three."""
    words = load(spark, sf_dir, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    n = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return n.select("word", "n", (F.col("n") >= 5).alias("common"), (F.col("n") >= 3).alias("spoken"))


def bigrams(spark, sf_dir):
    pairs = load(spark, sf_dir, "conversations").select(F.explode(text.grams(text.tokens(F.col("text")), 2)).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n >= 3")


def capitals(spark, sf_dir):
    """Capitalised ASCII words seen in four texts or more."""
    w = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("texts")).where("texts >= 4")


def trigram_vote(spark, sf_dir):
    """For each conversation turn, the 64-id bin of documents that shares most of its rare trigrams."""
    # Grams are told apart by a 64-bit hash, a third of the bytes to shuffle.
    gram = F.explode(F.array_distinct(text.hashed_grams(text.tokens(F.col("text")), 3))).alias("gram")
    q = load(spark, sf_dir, "conversations").withColumn("q", F.concat_ws(":", "conv_id", "turn")).select("q", gram)
    d = load(spark, sf_dir, "documents").select("doc_id", gram)
    return aggregates.rare_votes(q, d, "q", "gram", "doc_id", 20, 64, 0.2)


def near_repeats(spark, sf_dir):
    """Texts of eight squeezed characters or more that come again within 600 ids."""
    d = load(spark, sf_dir, "documents").select("doc_id", text.squeezed(F.col("text")).alias("s")).where(F.length("s") >= 8)
    w = Window.partitionBy(F.sha2("s", 256)).orderBy("doc_id")
    near = (F.col("doc_id") - F.lag("doc_id").over(w) <= 600) | (F.lead("doc_id").over(w) - F.col("doc_id") <= 600)
    return d.withColumn("near", near).where("near").select("doc_id")


def closest_code(spark, sf_dir):
    """The code of least edit distance to each brand, the first listed of equal ones, if it is near."""
    codes = ["Brand#1", "Brand#12", "Brand#22", "Braid#3", "Brand#44"]
    listed = F.array(*[F.struct(F.levenshtein("p_brand", F.lit(c)).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("code")) for k, c in enumerate(codes)])
    best = load(spark, sf_dir, "part").select("p_brand").distinct().withColumn("best", F.array_min(listed))
    return best.select("p_brand", F.when(F.col("best.d") <= F.greatest(F.lit(1), F.floor(F.length("p_brand") / 4)), F.col("best.code")).alias("code"))


def html_links(spark, sf_dir):
    l = html.links(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return l.groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first_href"))


def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


def html_sections(spark, sf_dir):
    s = html.items_under_headings(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return s.groupBy("page_id", "section").agg(F.count("*").alias("paragraphs"))


def event_class(spark, sf_dir):
    """Kinds by the first rule that fits."""
    rules = [("^(view|click)$", "rest"), ("purch|sign", "major")]
    return load(spark, sf_dir, "events").groupBy(text.first_rule(F.col("event_type"), rules, "routine").alias("kind")).agg(F.count("*").alias("n"))


def tiered_search(spark, sf_dir):
    """Part names with a word, else with a prefix, else with the letters: the best tier only."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = F.lit("ri")
    tier = F.when(F.array_contains(F.split("p_name", " "), asked), 0).when(F.exists(F.split("p_name", " "), lambda w: w.startswith(asked)), 1).when(F.contains("p_name", asked), 2)
    hits = p.withColumn("tier", tier).where("tier is not null")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).select("p_partkey", "p_name", "tier")


def hash_ids(spark, sf_dir):
    """Row names by a short string hash, and visitors by a salted digest."""
    return load(spark, sf_dir, "customer").select("c_custkey", text.text_hash(F.col("c_name")).alias("name_hash"), text.salted("salt", F.col("c_name"), size=32).alias("visitor"))


def review_rank(spark, sf_dir):
    """Lines scored for review: summed and capped parts, a floor once there is any doubt; the top
    hundred, those of unjudged quality first."""
    c = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    marks = F.regexp_count("text", F.lit("[0-9]"))
    odd = F.regexp_count("text", F.lit("[#$%&*]"))
    raw = F.least(F.lit(60), 20 * marks) + F.when(F.col("toxic") == 1, 15).otherwise(0) + F.when(F.col("source") == "src0", 10).otherwise(0) + F.least(F.lit(40), 15 * odd) + F.when(F.col("n_chars") < 100, 20).otherwise(0)
    score = F.when(raw > 0, F.least(F.lit(100), F.greatest(F.lit(25), raw))).otherwise(0).cast("long")
    r = c.select("doc_id", F.col("quality").isNull().alias("open"), score.alias("score")).where("score > 0")
    return r.orderBy(F.desc("open"), F.desc("score"), "doc_id").limit(100)


def line_lengths(spark, sf_dir):
    """How long turns take to say, capped by twice the time to the next and ten seconds more."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", text.saying_seconds(F.col("text")).alias("own"))
    nxt = F.lead("own").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.round(F.greatest(F.lit(10.0), F.least(F.lit(360.0), F.coalesce(F.when(nxt <= 2 * F.col("own") + 10, nxt), F.col("own")))), 4).alias("seconds"))


def first_mentions(spark, sf_dir):
    """The first place in each turn of each glossary word."""
    words = ["the", "and", "ing", "th"]
    tok = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.tokens(F.col("text"))).alias("at", "word")).where(F.col("word").isin(*words))
    return tok.groupBy("conv_id", "turn", "word").agg(F.min("at").cast("long").alias("at"))


def weighted_sample(spark, sf_dir):
    """Twenty parts without replacement, larger ones likelier; the seed is a hash of the key."""
    u = (F.pmod(F.xxhash64("p_partkey", F.lit(7)), F.lit(1_000_000)) + 1) / 1_000_001
    return load(spark, sf_dir, "part").withColumn("rank", F.pow(u, 1 / F.col("p_size"))).orderBy(F.desc("rank"), "p_partkey").limit(20).select("p_partkey", "p_size")


# Greedy folds and alignment have no SQL; tests hold them against small cases and the standard library.


def lis_trusted(spark, sf_dir):
    """Of each user's events, those whose values lie on a longest run that never falls."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return runs.longest_run(e, ["user_id"], ["event_id"], "value")


def trim_intervals(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 1.0).alias("a"), (F.col("event_id") + F.col("value") * 20).alias("b"), F.floor(F.col("value") / 10).alias("anchors"))
    return folds.trim_overlaps(e, ["user_id"], "a", "b", "anchors")


def merge_pieces(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 1.0).alias("a"), (F.col("event_id") + F.col("value") * 20).alias("b"), (F.col("value") % 50).alias("offset"))
    return folds.merge_pieces(e, ["user_id"], "a", "b", "offset")


def offset_groups(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 1.0).alias("t"), (F.col("value") % 40).alias("offset"))
    return folds.group_by_offset(e, ["user_id"], "t", "offset")


def phase_fold(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 30, F.col("event_id") % 7).alias("kind"))
    return folds.phase_fold(e, ["user_id"], "event_id", "kind")


def align_share(spark, sf_dir):
    """Benchmark items against all documents that share three trigrams, however common these are:
    share of the item's words that are found in order, and where they begin."""
    b = load(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("line"))
    d = load(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    g = lambda df, k, w: df.select(k, F.explode(F.array_distinct(text.grams(F.col(w), 3))).alias("gram"))
    pairs = g(d, "doc_id", "words").join(g(b, "item_id", "line"), "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 3")
    times = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: k.cast("double"))
    rows = pairs.join(b, "item_id").join(d, "doc_id")
    return rows.withColumn("found", align.find_udf("line", "words", times)).select("item_id", "doc_id", "shared", "found.t", F.round("found.share", 6).alias("share"))


def fuzzy_band(spark, sf_dir):
    """Turns against the turns of the same number in the four conversations before and after: the best
    fuzzy match of the whole texts, of equals the first."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", text.squeezed(F.col("text")).alias("s"))
    return best_in_band(c)


def best_in_band(c):
    """c: conv_id, turn, s. The most like text within four conversations."""
    o = c.select(F.col("conv_id").alias("other"), "turn", F.col("s").alias("os"))
    near = joins.band_join(c, o, ["turn"], "conv_id", "other", 4, 4).where("conv_id <> other").withColumn("ratio", F.round(align.ratio_udf("s", "os"), 6))
    return near.groupBy("conv_id", "turn").agg(F.max_by("other", F.struct("ratio", -F.col("other"))).alias("other"), F.max("ratio").alias("ratio"))


def stream_daily_counts(spark, sf_dir):
    """The daily counters as a stream over the event files, run to its end in complete mode."""
    name = f"daily_{uuid.uuid4().hex}"
    counters.run_once(counters.daily_counts(counters.read_events(spark, f"{sf_dir}/events.parquet")), "complete", name, f"{scratch.shared_dir(spark)}/{name}")
    return spark.table(name)


QUERIES = {f.__name__: f for f in (
    token_vocab, bigrams, capitals, trigram_vote, near_repeats, closest_code, html_links, html_title, html_sections, event_class, tiered_search, hash_ids, review_rank, line_lengths, first_mentions,
    weighted_sample, lis_trusted, trim_intervals, merge_pieces, offset_groups, phase_fold, align_share, fuzzy_band, stream_daily_counts,
)}

TOK = "regexp_extract_all(lower(replace({t}, '''', '')), '[a-z0-9]+')"
ORACLE_SQL = {
    "token_vocab": f"WITH w AS (SELECT unnest({TOK.format(t='text')}) AS word FROM conversations) SELECT word, count(*) AS n, count(*) >= 5 AS common, count(*) >= 3 AS spoken FROM w GROUP BY 1 HAVING count(*) >= 2",
    "bigrams": f"WITH t AS (SELECT {TOK.format(t='text')} AS w FROM conversations), p AS (SELECT w[k] || ' ' || w[k + 1] AS pair FROM (SELECT w, unnest(range(1, len(w))) AS k FROM t)) SELECT pair, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3",
    "capitals": "WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS word FROM conversations) SELECT word, count(*) AS texts FROM w GROUP BY 1 HAVING count(*) >= 4",
    "trigram_vote": f"""WITH c AS (SELECT conv_id || ':' || turn AS q, {TOK.format(t='text')} AS w FROM conversations), d AS (SELECT doc_id, {TOK.format(t='text')} AS w FROM documents),
cg AS (SELECT DISTINCT q, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram FROM (SELECT q, w, unnest(range(1, len(w) - 1)) AS k FROM c)), dg AS (SELECT DISTINCT doc_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
h AS (SELECT gram, count(*) AS n FROM dg GROUP BY 1 HAVING count(*) <= 20), v AS (SELECT q, doc_id // 64 AS bin, sum(1.0 / n) AS score FROM cg JOIN dg USING (gram) JOIN h USING (gram) GROUP BY ALL)
SELECT q, bin, round(score, 2) AS score FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, bin) = 1 AND round(score, 2) >= 0.2""",
    "near_repeats": "WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM documents), n AS (SELECT doc_id, doc_id - lag(doc_id) OVER w AS a, lead(doc_id) OVER w - doc_id AS b FROM d WHERE length(s) >= 8 WINDOW w AS (PARTITION BY s ORDER BY doc_id)) SELECT doc_id FROM n WHERE a <= 600 OR b <= 600",
    "closest_code": "WITH b AS (SELECT DISTINCT p_brand FROM part), c(k, code) AS (VALUES (0, 'Brand#1'), (1, 'Brand#12'), (2, 'Brand#22'), (3, 'Braid#3'), (4, 'Brand#44')), r AS (SELECT p_brand, code, levenshtein(p_brand, code) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY levenshtein(p_brand, code), k) AS n FROM b, c) SELECT p_brand, CASE WHEN d <= greatest(1, floor(length(p_brand) / 4)) THEN code END AS code FROM r WHERE n = 1",
    "html_links": "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"[^>]*>', 1)) AS href FROM pages) SELECT page_id, count(DISTINCT href) AS links, min(href) AS first_href FROM l GROUP BY 1",
    "html_title": r"""WITH t AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM t""",
    "event_class": "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'rest' WHEN event_type IN ('purchase', 'signup') THEN 'major' ELSE 'routine' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "tiered_search": "WITH t AS (SELECT p_partkey, p_name, CASE WHEN list_contains(string_split(p_name, ' '), 'ri') THEN 0 WHEN len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'ri'))) > 0 THEN 1 WHEN contains(p_name, 'ri') THEN 2 END AS tier FROM part) SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)",
    "review_rank": "WITH c AS (SELECT doc_id, quality IS NULL AS open, least(60, 20 * len(regexp_extract_all(text, '[0-9]'))) + CASE WHEN toxic = 1 THEN 15 ELSE 0 END + CASE WHEN source = 'src0' THEN 10 ELSE 0 END + least(40, 15 * len(regexp_extract_all(text, '[#$%&*]'))) + CASE WHEN n_chars < 100 THEN 20 ELSE 0 END AS raw FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, open, CAST(least(100, greatest(25, raw)) AS BIGINT) AS score FROM c WHERE raw > 0 ORDER BY open DESC, score DESC, doc_id LIMIT 100",
    "line_lengths": "WITH c AS (SELECT conv_id, turn, 2 + 0.09::DOUBLE * len(regexp_extract_all(text, '[A-Za-z]')) + len(regexp_extract_all(text, '[0-9]')) + 3 * len(regexp_extract_all(text, '\\*{3}|\\.{3}')) AS own FROM conversations), n AS (SELECT *, lead(own) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM c) SELECT conv_id, turn, round(greatest(10.0::DOUBLE, least(360.0::DOUBLE, CASE WHEN nx <= 2 * own + 10 THEN nx ELSE own END)), 4) AS seconds FROM n",
    "first_mentions": f"WITH t AS (SELECT conv_id, turn, {TOK.format(t='text')} AS w FROM conversations), g(word) AS (VALUES ('the'), ('and'), ('ing'), ('th')) SELECT conv_id, turn, word, CAST(list_position(w, word) - 1 AS BIGINT) AS at FROM t, g WHERE list_contains(w, word)",
    "phase_fold": "SELECT user_id, event_id, CASE WHEN value > 30 THEN event_id % 7 END AS kind, max(CASE WHEN value > 30 THEN event_id % 7 END) OVER (PARTITION BY user_id ORDER BY event_id) AS stage FROM events",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
