"""Queries over words in rows and texts: scraps, notes, announced times, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes
from ..operators import announcer, counts, rewrite, scraps, transcripts
from ..operators import fixes as fixes_
from ..sources import html
from ..sources.tables import load

#: Of terms in the documents and turns; the first two are one family.
RULES = [
    notes.Rule(r"\b([A-Z])([a-z]+) ([A-Z])[a-z]+\b", r"\1\3", r"\2", family="names"),
    notes.Rule(r"\bDr\. \w+", "A doctor", family="names"),
    notes.Rule(r"\b\d{4}-\d\d-\d\d\b", "A date"),
    notes.Rule(r"\b\d+(?:\.\d+)?\b", "A number", when="[a-z]"),
    notes.Rule(r"\b[A-Z]{2,}\b", "Capitals", only="[AEIOU]"),
]
FAMILIES = [notes.Family("names", "Names", least=3)]


def lines(spark, sf_dir):
    """Lines of all documents, each with an id of its own."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    each = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return each.withColumn("id", F.concat_ws(":", "doc_id", "line"))


def vocabulary(spark, sf_dir):
    w = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").select("word")


def scrap_lines(spark, sf_dir):
    """Lines of each document, those without a word, and those of letter scraps."""
    v = vocabulary(spark, sf_dir)
    l = scraps.with_fold(scraps.with_scraps(lines(spark, sf_dir), "id", "t", v), "id", "t", v)
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("scraps").alias("scraps"), F.count_if("fold").alias("folds"))


def noted_words(spark, sf_dir):
    """Turns with the words of a note set among their first words, one letter of each lost in every second
    turn, and the note taken out again."""
    note = ["COMMUNICATIONS", "LINK", "IN", "USE", "BETWEEN", "CC", "AND", "CM"]
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    of = F.array(*[F.when(F.lit(len(n) < 5) | (F.col("turn") % 2 == 0), n).otherwise(n[:2] + "_" + n[3:]) for n in note])
    mixed = F.flatten(F.zip_with(of, F.slice("w", 1, len(note)), lambda a, b: F.array(a, F.coalesce(b, F.lit("-")))))
    taken = scraps.without_note(F.concat(mixed, F.slice("w", len(note) + 1, 100_000)), note)
    return c.select("conv_id", "turn", taken.alias("x")).select("conv_id", "turn", F.array_join("x.words", " ").alias("words"), "x.noted")


def term_notes(spark, sf_dir):
    """Notes on the terms of all documents and turns, by title."""
    t = load(spark, sf_dir, "documents").select("text").unionAll(load(spark, sf_dir, "conversations").select("text"))
    n = t.select(F.explode(notes.notes(F.col("text"), RULES, FAMILIES)).alias("n")).select("n.*")
    return n.groupBy("title").agg(F.count("*").alias("notes"), F.sum(F.col("to") - F.col("from")).alias("chars"))


def announced(spark, sf_dir):
    """Turns in which an announcer gives a time in one of four ways before, between or after their words."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    h, m = ((F.col("conv_id") + F.col("turn")) % 330).cast("string"), ((F.col("turn") * 7) % 61).cast("string")
    ways = [F.concat(F.lit("This is Apollo Control at "), h, F.lit(" hours at "), m, F.lit(" minutes.")), F.concat(F.lit("Mission Control, Houston, it's "), h, F.lit(" hours.")),
            F.concat(F.lit("At "), h, F.lit(" hours, "), m, F.lit(" minutes, this is Apollo Control.")), F.concat(F.lit("At "), h, F.lit(" hours, this is Mission Control."))]
    way = F.get(F.array(*ways), F.col("conv_id").cast("int") % 4)
    text = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", way, "text")).when(F.col("turn") % 3 == 1, F.concat_ws(" ", "text", way)).otherwise(F.concat_ws(" ", "text", way, "text"))
    said = c.select("conv_id", "turn", F.explode(transcripts.announced_times_udf(text)).alias("s"))
    return said.select("conv_id", "turn", "s.at", "s.seconds", "s.kind")


def count_anchors(spark, sf_dir):
    """Conversations as tapes, a spoken count after each turn; words in numbers are said as such."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    n = (F.col("turn") * 7 % 70).cast("string")
    ways = [F.concat(F.lit("T minus "), n), F.concat(F.lit("mark, T minus "), n, F.lit(" minutes, ten seconds")), F.concat(F.lit("at "), n, F.lit(" minutes, 5 seconds into the flight")), F.concat(F.lit("Mark "), n, F.lit(" minutes"))]
    text = F.concat_ws(" ", "text", F.get(F.array(*ways), F.col("turn").cast("int") % 4))
    words = c.select(F.col("conv_id").alias("tape"), "turn", F.posexplode(F.split(text, " ")).alias("k", "token"))
    seq = F.col("turn") * 100_000 + F.col("k")
    return counts.anchors(words.select("tape", (F.col("turn") * 1000 + F.col("k") * 0.25).alias("t"), seq.alias("seq"), "token"), ["tape"])


def announced_stretches(spark, sf_dir):
    """Conversations as tapes of one word each 0.4 seconds, turns half a minute apart, every fifth turn the
    announcer's; turns of users are the crew's lines. Each announcement, parted by the times that it
    gives, with where it starts and ends and how many words it has."""
    c = load(spark, sf_dir, "conversations").where("text is not null").withColumn("his", F.col("turn") % 5 == 1)
    hour = (F.col("turn") * 3 + F.col("conv_id") % 50).cast("string")
    said = F.concat(F.lit("This is Apollo Control at "), hour, F.lit(" hours, 5 minutes. "), F.substring_index("text", " ", 30))
    at = F.col("turn") * 30.0
    tokens = F.split(F.when(F.col("his"), said).otherwise(F.substring_index("text", " ", 60)), r"\s+")
    words = c.select(F.col("conv_id").alias("tape"), at.alias("at"), F.posexplode(tokens).alias("k", "token")).select("tape", (F.col("at") + 0.4 * F.col("k")).alias("start"), (F.col("at") + 0.4 * F.col("k") + 0.3).alias("end"), "token")
    crew = c.where("role = 'user' and not his").select(F.col("conv_id").alias("tape"), at.alias("t"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"), (F.col("turn") % 2 == 0).alias("heard"))
    tapes = c.groupBy("conv_id").agg((F.max("turn") * 30.0 + 60).alias("to")).select(F.col("conv_id").alias("tape"), F.lit(0.0).alias("from"), "to")
    found = announcer.announcements(words, crew, tapes, ["capcom", "cc"]).withColumn("rate", F.lit(1.0))
    return announcer.parted(found).select("tape", F.round("t0", 2).alias("t0"), F.round("t1", 2).alias("t1"), F.size("words").alias("words"), F.size("over_words").alias("over_words"))


LINK, AD, BLOCK, HEADING = r'(?i)<a\s+href="([^"]*)"', r"<!-- ad (\d+) -->", r"(?s)<p>(.*?)</p>", r"<h[1-6]>([^<]*)</h[1-6]>"


def stamped_links(spark, sf_dir):
    """Links of pages with the number of the nearest advertisement: 600 characters before at most, or 150
    after."""
    return html.timed_links(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", LINK, AD)


def anchored_blocks(spark, sf_dir):
    """Paragraphs of pages by the last advertisement before them."""
    b = html.blocks_after_anchors(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", BLOCK, AD)
    return b.groupBy("page_id", "anchor").agg(F.count("*").alias("blocks"), F.min("at").alias("first"), F.sum(F.length("text")).alias("chars"))


def headed_texts(spark, sf_dir):
    """What follows each heading of a page up to the next one, or a thousand characters after the last."""
    return html.rows_to_next(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", HEADING)


def printed_fixes(spark, sf_dir):
    """Turns whose printed second is put right where the fix's words are near; the fixes ask for every fourth
    turn, half of them by a text that no turn has."""
    c = load(spark, sf_dir, "conversations").where("text is not null")
    rows = c.select(F.col("conv_id").alias("mission"), F.col("turn").alias("line"), (F.col("turn") * 10.0).alias("g"), F.col("text").alias("t"))
    part = F.when(F.col("line") % 8 == 0, F.upper(F.substring("t", 3, 12))).otherwise("no turn says so")
    fixes = rows.where("line % 4 = 0").select("mission", F.col("line").alias("fix"), (F.col("g") + 1.5).alias("g"), part.alias("t"), (F.col("g") + 100).alias("printed"))
    done, unmet = fixes_.printed_times(rows, fixes)
    left = unmet.select("mission", F.col("fix").alias("line"), F.lit(True).alias("unmet"))
    return done.join(left, ["mission", "line"], "left").select("mission", "line", "g", "fixed", F.coalesce("unmet", F.lit(False)).alias("unmet"))


def rewritten_turns(spark, sf_dir):
    """Turns with damage of four kinds (o read as 0, l as 1, words broken at a hyphen, blanks before stops),
    rewritten by the general rules; and whether the turn is as it was before."""
    v = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    c = load(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"\b([a-z]{3,}) \1\b", "$1").alias("was"), "turn")
    kinds = [F.regexp_replace("was", "(?<=[a-z])o(?=[a-z])", "0"), F.regexp_replace("was", "(?<=[a-z])l(?=[a-z])", "1"), F.regexp_replace("was", r"\b([a-z]{3})([a-z]{3,})\b", "$1- $2"), F.regexp_replace("was", r"(?<=[a-z])\.", " .")]
    damaged = c.select("id", "was", F.get(F.array(*kinds), (F.col("turn") % 4).cast("int")).alias("text"))
    out = rewrite.rewritten(damaged, "id", "text", rewrite.GENERAL, v)
    return out.select("id", "text", (F.col("text") == F.col("was")).alias("as_before"))


QUERIES = {f.__name__: f for f in (scrap_lines, noted_words, term_notes, announced, count_anchors, announced_stretches, stamped_links, anchored_blocks, headed_texts, printed_fixes, rewritten_turns)}

_WORDS = r"list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')"
_BARE = r"list_transform(tokens, lambda x: regexp_replace(regexp_replace(x, '''(?:s|t|d|m|ll|re|ve)[^A-Za-z]*$', '', 'i'), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))"
_LETTERS = r"length(regexp_replace({}, '[^A-Za-z]', '', 'g'))"
ORACLE_SQL = {
    "scrap_lines": rf"""
WITH v AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), known AS (SELECT word FROM v GROUP BY 1 HAVING count(*) >= 3),
l AS (SELECT doc_id, line, t, {_WORDS} AS tokens, list_filter(regexp_extract_all(t, '[A-Za-z'']+'), lambda c: length(c) >= 2) AS clumps FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, {_BARE} AS bare FROM l), p AS (SELECT *, flatten(list_transform(bare, lambda w: regexp_split_to_array(w, '[-/]'))) AS parts FROM b),
k AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, line, unnest(list_filter(parts, lambda x: regexp_full_match(x, '\p{{L}}{{2,}}'))) AS w FROM p) WHERE lower(w) IN (SELECT word FROM known) OR regexp_replace(lower(w), 's+$', '') IN (SELECT word FROM known)),
c AS (SELECT doc_id, line, count(*) AS n, max(length(w)) AS longest, min(i) AS first FROM (SELECT doc_id, line, generate_subscripts(clumps, 1) AS i, lower(unnest(clumps)) AS w FROM l) WHERE w IN (SELECT word FROM known) GROUP BY ALL),
s AS (SELECT p.doc_id,
  NOT (len(tokens) > 0 AND regexp_full_match(trim(t, ' '), '[-. *?!()]+') OR len(list_filter(bare, lambda w: {_LETTERS.format('w')} >= 4)) > 0
    OR len(list_filter(parts, lambda x: regexp_full_match(x, '\d[\d.,:+]*|[A-Z]+\d+[A-Z]*|[A-Z]{{2,}}|[A-Z][a-z]{{2,}}|[aAiI]'))) > 0 OR k.line IS NOT NULL
    OR len(tokens) = 1 AND regexp_matches(tokens[1], '^[^A-Za-z0-9]*[A-Z]') AND {_LETTERS.format('tokens[1]')} >= 2) AS scraps,
  len(clumps) >= 3 AND NOT regexp_matches(t, '\d') AND coalesce(c.n, 0) < 0.4 * len(clumps) AND coalesce(c.longest, 0) < 4 AND NOT (coalesce(c.first, 0) = 1 AND regexp_matches(t, '^\W*[A-Za-z]+[.?!]')) AS fold
  FROM p LEFT JOIN k USING (doc_id, line) LEFT JOIN c USING (doc_id, line))
SELECT doc_id, count(*) AS lines, count(*) FILTER (scraps) AS scraps, count(*) FILTER (fold) AS folds FROM s GROUP BY 1""",
    "printed_fixes": r"""
WITH c AS (SELECT conv_id AS mission, turn AS line, turn * 10.0::DOUBLE AS g, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t, text FROM conversations WHERE text IS NOT NULL),
f AS (SELECT mission, line AS fix, g + 1.5 AS g, g + 100 AS printed, CASE WHEN line % 8 = 0 THEN regexp_replace(lower(upper(substring(text, 3, 12))), '[^a-z0-9]', '', 'g') ELSE 'noturnsaysso' END AS t FROM c WHERE line % 4 = 0),
h AS (SELECT c.mission, line, fix, printed FROM c JOIN f ON c.mission = f.mission AND abs(c.g - f.g) <= 2 AND contains(c.t, f.t)), n AS (SELECT mission, line, arg_max(printed, fix) AS new FROM h GROUP BY ALL),
u AS (SELECT mission, fix AS line FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.mission = f.mission AND h.fix = f.fix) AND NOT EXISTS (SELECT 1 FROM c WHERE c.mission = f.mission AND c.g = f.printed AND contains(c.t, f.t)))
SELECT c.mission, c.line, coalesce(n.new, c.g) AS g, n.new IS NOT NULL AS fixed, u.line IS NOT NULL AS unmet FROM c LEFT JOIN n USING (mission, line) LEFT JOIN u USING (mission, line)""",
}
