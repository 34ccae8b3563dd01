"""Saved web pages as rows: links, headings and items by their position in the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_html
from ..operators.joins import asof


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at (place among the page's links), href and label of each link; one row for each href of
    a page, the first."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select(key, F.posexplode(anchors).alias("at", "a"))
    href = F.regexp_extract("a", r'(?is)href="([^"]*)"', 1)
    return rows.groupBy(key, href.alias("href")).agg(F.min("at").alias("at"), F.min_by(clean_html(F.col("a")), "at").alias("label"))


def items_under_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Paragraphs and headings in order of the page; a paragraph has the last heading before it."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>(?:(?!<h[1-6]\b|<p\b).)*"), F.lit(0))
    rows = pages.select(key, F.posexplode(blocks).alias("at", "b"))
    heading = F.col("b").rlike(r"(?i)^<h[1-6]")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(heading, clean_html(F.col("b"))), True).over(w)).where(~heading).select(key, "at", "section", clean_html(F.col("b")).alias("text"))


def located(pages: DataFrame, key: str, html: str, pattern: str, group: int = 0) -> DataFrame:
    """key, at, end (characters from the start of the page) and found (the group) of each match of a pattern
    that is never empty. A page's places are the running lengths of what lies between and in matches."""
    both = F.arrays_zip(F.split(html, pattern, -1).alias("gap"), F.regexp_extract_all(html, F.lit(f"({pattern})"), F.lit(1)).alias("whole"), F.regexp_extract_all(html, F.lit(pattern), F.lit(group)).alias("own"))
    rows = pages.where(F.col(html).isNotNull()).select(key, F.posexplode(both).alias("_k", "_p"))
    ends = F.sum(F.length("_p.gap") + F.length(F.coalesce("_p.whole", F.lit("")))).over(Window.partitionBy(key).orderBy("_k"))
    return rows.withColumn("end", ends).where(F.col("_p.whole").isNotNull()).select(key, (F.col("end") - F.length("_p.whole")).alias("at"), "end", F.col("_p.own").alias("found"))


def timed_links(pages: DataFrame, key: str, html: str, link: str, stamp: str, before: int = 600, after: int = 150) -> DataFrame:
    """key, at, href and stamp of each link (`link`, group 1), the first of each href in a page that has a
    stamp near: the last one up to `before` characters before it or the first up to `after` after it,
    the nearer of the two, the one before of equals. White space within an href goes."""
    l = located(pages, key, html, link, 1).select(key, F.col("at").alias("_pos"), F.regexp_replace("found", r"\s+", "").alias("href"))
    s = located(pages, key, html, stamp, 1).select(key, F.col("at").alias("_stamp"), F.col("found").alias("stamp"))
    l = asof(l, s, [key], "_pos", "_stamp", ["stamp"], 10_000, strict=True, to="_back")
    l = asof(l, s, [key], "_pos", "_stamp", ["stamp"], 10_000, forward=True, strict=True, to="_on")
    back, on = F.col("_pos") - F.col("_back._stamp"), F.col("_on._stamp") - F.col("_pos")
    near = F.when((back <= before) & ((back <= on) | F.coalesce(on > after, F.lit(True))), F.col("_back.stamp")).when(on <= after, F.col("_on.stamp")).when(back <= before, F.col("_back.stamp"))
    return l.withColumn("stamp", near).where("stamp is not null").groupBy(key, "href").agg(F.min("_pos").alias("at"), F.min_by("stamp", "_pos").alias("stamp")).select(key, "at", "href", "stamp")


def blocks_after_anchors(pages: DataFrame, key: str, html: str, block: str, anchor: str, most: int = 600) -> DataFrame:
    """key, at, anchor and text of each block (group 1) that has an anchor (group 1) at or before its start;
    blocks without text go. Texts are cut at `most`."""
    b = located(pages, key, html, block, 1).select(key, F.col("at").alias("_pos"), clean_html(F.col("found")).alias("text")).where("text <> ''")
    a = located(pages, key, html, anchor, 1).select(key, F.col("at").alias("_anchor"), F.col("found").alias("anchor"))
    return asof(b, a, [key], "_pos", "_anchor", ["anchor"], 10_000, to="_m").where("_m is not null").select(key, F.col("_pos").alias("at"), F.col("_m.anchor").alias("anchor"), F.substring("text", 1, most).alias("text"))


def rows_to_next(pages: DataFrame, key: str, html: str, start: str, last: int = 1000, most: int = 600) -> DataFrame:
    """key, at, found (group 1) and text of each row of a page: what follows a start up to the next one, or
    `last` characters after the last. Rows without text go, texts are cut at `most`."""
    s = located(pages, key, html, start, 1).withColumn("_next", F.lead("at").over(Window.partitionBy(key).orderBy("at")))
    whole = s.join(pages.select(key, F.col(html).alias("_html")), key)
    length = F.coalesce(F.col("_next") - F.col("end"), F.lit(last))
    text = clean_html(F.expr("substring(_html, cast(end + 1 as int), cast(_len as int))"))
    return whole.withColumn("_len", length).select(key, "at", "found", F.substring(text, 1, most).alias("text")).where("text <> ''")
