"""The query of each operator over its whole table. Operators keep their own outputs; the queries
derive counts and digests from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, jaccard_join, langid, lexical, maxent_lm, media, pii, resharding, simhash, suffix_dedup, url_rules
from .common import crc_mod, load, shared_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hex_sha(col):
    return F.sha2(col, 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, load(spark, sf_dir, "benchmark")).drop("text")
    n_hit = F.aggregate("leaks.ranges", F.lit(0).cast("long"), lambda a, r: a + r["word_to"] - r["word_from"])
    return found.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        hex_sha(F.array_join("leaks.items", ",").cast("binary")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n = [count(kind) for kind in pii.KINDS]
    more = [F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.ADDED]
    found = F.size("all").cast("long").alias("n_spans")
    return rows.select("doc_id", *n, hex_sha(pii.listed(F.col("base")).cast("binary")).alias("base_sha256"), pii.listed(F.col("all")).alias("spans"), *more, found)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.Spec(spark, tokenizer_path())
    return bpe.round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"), spec).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        hex_sha(F.col("ids")).alias("ids_sha256"),
        hex_sha(F.col("decoded").cast("binary")).alias("decoded_sha256"),
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 5)
    model = langid.train(docs.where(rest != 0))
    said = langid.predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("cut.removed").alias("n_removed"),
        F.col("cut.spans").alias("n_spans"),
        hex_sha(F.col("cut.kept")).alias("kept_sha256"),
    )


#: The rules that are given, and two globs that judge what no rule fits.
SITE_RULES = [
    url_rules.site_rule("allow", "org", "/"),
    url_rules.site_rule("block", "example.org", "/es/"),
    url_rules.site_rule("block", "example.org", "/en/1"),
    url_rules.site_rule("allow", "com", "/fr/"),
    url_rules.site_rule("block", "com", "/de/"),
]
GLOB_RULES = [url_rules.Rule("*", "*/ads/*", "block", 0), url_rules.Rule("*.m.*", "*.html", "block", 0)]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(load(spark, sf_dir, "pages").select("page_id", "url"), SITE_RULES + GLOB_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    named, read = media.store_and_read(docs)
    rows = named.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    hexed = lambda c: F.lower(F.hex(c))
    return rows.join(read, "media").select("doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("media").alias("media_sha256"), "feature")


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(resharding.OLD_SHARDS))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows, changed = resharding.reshard(docs, old, resharding.size_of(F.col("text")), keep={"text": F.col("text")})
    out = rows.where(~F.col("shard").isin(changed)) if changed else rows
    if changed:  # what the rewritten files hold, and the rows of shards that keep theirs
        path = f"{shared_dir(spark)}/sparkloom-shards-{uuid.uuid4().hex}"
        resharding.rewrite(rows, changed, path)
        files = spark.read.parquet(path)
        untouched = set(range(resharding.NEW_SHARDS)) - set(changed)
        out = files if not untouched else files.unionByName(out)
    return out.select("doc_id", resharding.size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = maxent_lm.score(docs, crc_mod(F.col("doc_id"), 5) != 1)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, inertia = centroids.fit(vectors)
    rows = centroids.assign(vectors, found)
    number = F.col("cluster") + 1
    # Clusters without vectors have no rows, so their places are never read.
    sums = [inertia.get(j) for j in range(len(found))]
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    each = F.array(*[F.lit(fits(x)).cast("long") for x in sums])
    named = F.array(*[hex_sha(F.lit(",".join(map(str, c))).cast("binary")) for c in found])
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        (F.element_at(each, number) if found else F.lit(None).cast("long")).alias("cluster_inertia"),
        F.lit(fits(sum(inertia.values()))).cast("long").alias("inertia"),
        (F.element_at(named, number) if found else F.lit(None).cast("string")).alias("centroid_sha256"),
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.Index(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = index.search(load(spark, sf_dir, "benchmark").select("item_id", "text"))
    index.drop()
    return found


OPERATORS = [op1_decontamination, op2_pii, op3_bpe, op4_langid, op5_suffix_dedup, op6_urls, op7_media, op8_resharding, op9_maxent, op10_jaccard, op11_centroids, op12_simhash, op13_lexical]
QUERIES = {f.__name__: f for f in OPERATORS}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_TERMS = _WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


def _centroid_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """The rounds written out, one after the other."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, (min((d, j)))[2] AS j, (min((d, j)))[1] AS d FROM (SELECT r, j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n} c) GROUP BY r)")
        if n < rounds:
            cells = f"SELECT j, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(range(1, {dims + 1})) AS i, unnest(x) AS e FROM a{n} JOIN v USING (r)) GROUP BY ALL"
            parts.append(f"m{n} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM ({cells}) GROUP BY j)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.j = m.j)")
    return f"WITH {', '.join(parts)} SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON a.j = c.j"


ORACLE_SQL = {
    "op11_centroids": _centroid_sql(),
    "op13_lexical": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
g AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, n),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n) // l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
""",
    "op10_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY ALL
""",
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM b WHERE len(w) > 0),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: {{'k': k, 'g': array_to_string(w[k:k + n - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
h AS (SELECT doc_id, x.k AS k, g.n AS n, item FROM g JOIN i ON g.n = i.n AND x.g = i.g),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op6_urls": r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, rule,
  coalesce(action, CASE WHEN path LIKE '%/ads/%' OR ('.' || host LIKE '%.m.%' AND path LIKE '%.html') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits ON u.page_id = fits.page_id
""",
}
