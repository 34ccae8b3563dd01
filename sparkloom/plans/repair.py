"""Mending, searching and timing turns of conversation, misread and untimed on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import repair, timing
from ..sources.tables import load


def misread(spark, sf_dir):
    """Turns as a scan might read them: g as 6, m as rn."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(F.replace("text", F.lit("g"), F.lit("6")), F.lit("m"), F.lit("rn")).alias("text"))


def said(spark, sf_dir):
    """Words said twice or more."""
    words = load(spark, sf_dir, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def misread_words(spark, sf_dir):
    """The misread words of all turns, and what each can only stand for, if it has no more than eight
    characters that may be misread."""
    words = misread(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    cores = words.select(repair.parts(F.col("w"))["core"].alias("core")).distinct()
    bad = repair.suspects(cores, said(spark, sf_dir))
    return bad.join(repair.mends(bad, said(spark, sf_dir), repair.MOST_SPOTS), "core", "left").select("core", "mend")


def mended_turns(spark, sf_dir):
    """Turns with their misread words mended, also by the words beside them."""
    pairs = load(spark, sf_dir, "conversations").select(F.explode(text.grams(text.tokens(F.col("text")), 2)).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    two = pairs.select(F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("second"), "n")
    m = repair.mended(misread(spark, sf_dir), ["conv_id", "turn"], "text", said(spark, sf_dir), two)
    return m.select("conv_id", "turn", (F.col("mended") != F.col("text")).alias("changed"), F.md5("mended").alias("digest"))


def untimed_turns(spark, sf_dir):
    """Conversations as tapes on which a word is said each half second: only the first turn is timed."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("tokens"))
    lines = c.select("conv_id", "turn", F.when(F.col("turn") == 0, 1000.0).alias("at"), (F.col("turn") == 0).alias("timed"), "tokens")
    w = c.select("conv_id", "turn", F.posexplode("tokens").alias("k", "token"))
    # Turns do not interrupt each other: a turn begins a minute after the one before.
    g = 1000 + 60 * F.col("turn") + 0.5 * F.col("k")
    words = w.select("conv_id", g.cast("double").alias("g"), (g + 0.4).cast("double").alias("end"), (F.col("turn") * 100_000 + F.col("k")).alias("seq"), "token")
    return timing.timed_by_speech(lines, words, ["conv_id"], "turn", "at", "timed", "tokens").select("conv_id", "turn", "at", "how")


TERMS = ["the", "in the", "and", "a b", "lo", "Lo", "i", "re-do"]


def glossary_terms(spark, sf_dir):
    t = load(spark, sf_dir, "conversations").select(F.explode(text.terms_in(F.col("text"), TERMS)).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


KINDS = [("surface", r"\bwal"), ("lunar-orbit", "orb|qu"), ("earth", r"\bl[aeo]"), ("interior", "in")]


def text_kinds(spark, sf_dir):
    """Documents by the rules on their opening, else on all of them."""
    rules = [(pattern, kind) for kind, pattern in KINDS]
    d = load(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(text.first_then_whole(text.opening(F.col("text")), F.col("text"), rules, "other").alias("kind")).agg(F.count("*").alias("n"))


def frame_kinds(spark, sf_dir):
    """Parts as frames: brands are neighbours, types descriptions, makers rolls."""
    p = load(spark, sf_dir, "part")
    near = F.when(F.col("p_size") < 20, F.struct(F.when(F.col("p_size") < 10, "surface").otherwise("earth").alias("kind"), F.col("p_brand").alias("frame")))
    described = F.when(F.col("p_partkey") % 3 == 0, "surface").when(F.col("p_partkey") % 3 == 1, "lunar-orbit")
    k = labels.frame_kind(F.col("p_size") % 5 == 0, F.col("p_size") % 2 == 0, near, described, F.when(F.col("p_partkey") % 2 == 0, "interior"), F.lit("lunar-orbit"), ["earth", "lunar-orbit", "interior"])
    return p.select("p_partkey", k["kind"].alias("kind"), k["like"].alias("like"))


QUERIES = {f.__name__: f for f in (misread_words, mended_turns, untimed_turns, glossary_terms, text_kinds, frame_kinds)}

_SPOTS = ", ".join(f"('{k if k != chr(39) else chr(39) * 2}', '{v}')" for k, v in repair.CONFUSED.items())
_TWOS = ", ".join(f"('{k}', '{v}')" for k, v in repair.PAIRS.items())
_JOIN = ", ".join(f"'{w}'" for w in repair.JOINERS)
_ALLOWED = r"[^A-Za-z0-9''.,?!;:/&\-]"
ORACLE_SQL = {
    "misread_words": rf"""WITH voc AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(replace(text, '''', '')), '[a-z0-9]+')) AS word FROM conversations) GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT unnest(regexp_split_to_array(replace(replace(text, 'g', '6'), 'm', 'rn'), '\s+')) AS w FROM conversations),
c AS (SELECT DISTINCT regexp_extract(w, '^(["(]*)(.*?)([.,?!;:"'')]*)$', 2) AS core FROM t WHERE w <> ''),
v AS (SELECT core, regexp_replace(core, '[^A-Za-z]', '', 'g') AS l FROM c),
h AS (SELECT core, CASE WHEN l = '' OR regexp_full_match(l, '[A-Z]+s|[A-Z]{{1,4}}') THEN 'sound'
  WHEN regexp_matches(core, '{_ALLOWED}|^[;:,.][A-Za-z]|[A-Za-z][,;:][A-Za-z]') THEN 'damaged'
  WHEN l = upper(l) OR regexp_full_match(core, '(?:Mc|Mac|O'')[A-Z][a-z]+|(?:[A-Za-z]\.)+[A-Za-z]?') THEN 'sound'
  WHEN regexp_full_match(core, '[A-Za-z]{{4,}}/[A-Za-z]{{4,}}') AND lower(split_part(core, '/', 1)) IN (SELECT word FROM voc) AND lower(split_part(core, '/', 2)) IN (SELECT word FROM voc) THEN 'sound'
  WHEN regexp_full_match(core, '(?:\d+/)?\d+(?:st|nd|rd|th|s)') THEN 'sound'
  WHEN regexp_matches(core, '[a-z][\d.,;:/?!%][a-z]|[a-z]\d|\d[a-z]{{2}}') THEN 'damaged'
  WHEN regexp_matches(core, '[a-z]''[a-z]') AND NOT regexp_matches(core, '''(s|t|d|m|ll|re|ve)$') AND lower(core) NOT IN (SELECT word FROM voc) THEN 'damaged'
  WHEN regexp_full_match(core, '[A-Za-z]{{4,}}') AND lower(core) NOT IN (SELECT word FROM voc) AND (lower(core) NOT LIKE '%s' OR lower(core[:-2]) NOT IN (SELECT word FROM voc)) THEN 'damaged' ELSE 'sound' END AS how FROM v),
bad AS (SELECT core FROM h WHERE how = 'damaged'),
spots(ch, alts) AS (VALUES {_SPOTS}), twos(old, new) AS (VALUES {_TWOS}),
place AS (SELECT core, unnest(range(1, length(core) + 1)) AS p FROM bad),
one AS (SELECT core, p, alts FROM place JOIN spots ON core[p] = ch WHERE NOT (ch = '_' AND length(core) < 4)),
marks AS (SELECT core, count(*) AS k FROM place JOIN spots ON core[p] = ch GROUP BY 1),
cand AS (SELECT core, core[:p - 1] || unnest(string_split(alts, '')) || core[p + 1:] AS x FROM one
  UNION SELECT core, core[:strpos(core, old) - 1] || new || core[strpos(core, old) + 2:] FROM bad, twos WHERE strpos(core, old) > 0
  UNION SELECT core, replace(core, '_', '') FROM bad WHERE regexp_full_match(core, '[A-Za-z]+_[A-Za-z]+') AND length(core) >= 7),
fit AS (SELECT DISTINCT core, word AS mend, n FROM cand JOIN voc ON lower(x) = word WHERE regexp_full_match(x, '[A-Za-z]+')
  UNION SELECT core, lower(core[:k]) || ' ' || word, 0 FROM (SELECT core, unnest(range(1, 5)) AS k FROM bad WHERE regexp_full_match(core, '[A-Za-z]{{6,}}')) JOIN voc ON lower(core[k + 1:]) = word WHERE lower(core[:k]) IN ({_JOIN}) AND length(word) >= 4),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY core) AS k, lead(n) OVER w AS second FROM fit WINDOW w AS (PARTITION BY core ORDER BY n DESC, mend)),
m AS (SELECT core, mend FROM r WHERE i = 1 AND (k = 1 OR n >= 3 AND n >= 3 * second) AND core NOT IN (SELECT core FROM marks WHERE k > {repair.MOST_SPOTS}) AND NOT (core LIKE '%\_' ESCAPE '\' AND length(core) >= 5 AND lower(core[:-2]) IN (SELECT word FROM voc)))
SELECT core, mend FROM bad LEFT JOIN m USING (core)""",
    "glossary_terms": r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b(in the|re-do|a b|and|the|Lo|lo|i)\b')) AS term FROM conversations) GROUP BY 1",
    "text_kinds": r"""WITH d AS (SELECT lower(text) AS t, trim(regexp_replace(trim(regexp_replace(CASE WHEN contains(text, '---') THEN text[strpos(text, '---') + 3:] ELSE text END, '\s+', ' ', 'g')), '(?i)(?:Photo credit|Image credit|Editor.s note).*$', '')) AS own FROM documents WHERE text IS NOT NULL),
o AS (SELECT t, lower(trim(coalesce(nullif(regexp_extract(own, '^(.{40,260}?[.!?])(?:\s|$)', 1), ''), own[:260]))) AS o FROM d)
SELECT CASE WHEN regexp_matches(o, '\bwal') THEN 'surface' WHEN regexp_matches(o, 'orb|qu') THEN 'lunar-orbit' WHEN regexp_matches(o, '\bl[aeo]') THEN 'earth' WHEN regexp_matches(o, 'in') THEN 'interior'
WHEN regexp_matches(t, '\bwal') THEN 'surface' WHEN regexp_matches(t, 'orb|qu') THEN 'lunar-orbit' WHEN regexp_matches(t, '\bl[aeo]') THEN 'earth' WHEN regexp_matches(t, 'in') THEN 'interior' ELSE 'other' END AS kind, count(*) AS n FROM o GROUP BY 1""",
    "frame_kinds": """WITH p AS (SELECT p_partkey, p_brand, p_size % 5 = 0 AS foot, CASE WHEN p_size < 10 THEN 'surface' WHEN p_size < 20 THEN 'earth' END AS near, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'surface' END WHEN 1 THEN 'lunar-orbit' END AS said, p_partkey % 2 = 0 AS even FROM part)
SELECT p_partkey, CASE WHEN foot THEN coalesce(near, 'surface') WHEN near = 'earth' THEN near ELSE coalesce(said, CASE WHEN even THEN 'interior' END, 'lunar-orbit') END AS kind, CASE WHEN (foot OR near = 'earth') AND near IS NOT NULL THEN p_brand END AS like FROM p""",
}
