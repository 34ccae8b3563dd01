"""Queries without SQL over the given tables, against plain Python over the same rows."""

import hashlib
import re

import pytest

from sparkloom.operators import fixes, folds
from sparkloom.plans import texts, words
from sparkloom.sources import html

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def spots(text, pattern, group=1):
    return [(m.start(), m.end(), m[group]) for m in re.finditer(pattern, text)]


def plain_links(text, link, stamp):
    seen, out = set(), []
    for at, _, href in spots(text, link):
        href = re.sub(r"\s+", "", href)
        before = [(at - s, v) for s, _, v in spots(text, stamp) if 0 < at - s <= 600][-1:]
        after = [(s - at, v) for s, _, v in spots(text, stamp) if 0 < s - at <= 150][:1]
        near = min(before + after, key=lambda x: x[0], default=None)  # the one before comes first among equals
        if href not in seen and near:
            seen.add(href)
            out.append((at, href, near[1]))
    return out


def test_links_near_stamps(spark):
    got = {tuple(r) for r in words.stamped_links(spark, SF).collect()}
    assert got == {(p["page_id"], *x) for p in rows(spark, "pages") for x in plain_links(p["html"], words.LINK, words.AD)} and got
    pad = lambda n: "." * n
    cases = [
        f'T1{pad(598)}<a href="x">', f'T1{pad(599)}<a href="x">', f'<a href="x">{pad(138)}T2', f'<a href="x">{pad(139)}T2', f'T1{pad(18)}<a href="x">{pad(8)}T2',
        f'T1{pad(30)}<a href="x">{pad(8)}T2', f'T1{pad(5)}<a href="x"><a href=" x">', "T1", None, "", '<a href="x">', f'T3T1{pad(700)}<a href="a">{pad(700)}T2<a href="a">',
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, h string")
    got = {tuple(r) for r in html.timed_links(df, "k", "h", r'<a href="([^"]*)">', r"T(\d)").collect()}
    assert got == {(k, *x) for k, c in enumerate(cases) if c for x in plain_links(c, r'<a href="([^"]*)">', r"T(\d)")}


def cleaned(spark, parts):
    """The library's own cleaning of markup, which has its tests."""
    from pyspark.sql import functions as F

    from sparkloom.functions.text import clean_html

    df = spark.createDataFrame(list(enumerate(parts)), "k int, h string").select("k", clean_html(F.col("h")))
    return [t for _, t in sorted((r[0], r[1]) for r in df.collect())]


def test_blocks_and_rows_of_pages(spark):
    pages = rows(spark, "pages")
    blocks = [(p["page_id"], at, [v for s, _, v in spots(p["html"], words.AD) if s <= at][-1:], t) for p in pages for at, _, t in spots(p["html"], words.BLOCK)]
    want = {}
    for (page, at, anchor, _), t in zip(blocks, cleaned(spark, [b[3] for b in blocks])):
        if t and anchor:
            n, first, chars = want.get((page, anchor[0]), (0, at, 0))
            want[page, anchor[0]] = (n + 1, min(first, at), chars + len(t[:600]))
    assert {(r["page_id"], r["anchor"]): (r["blocks"], r["first"], r["chars"]) for r in words.anchored_blocks(spark, SF).collect()} == want and want
    heads = [(p["page_id"], at, v, p["html"][end : (spots(p["html"], words.HEADING)[k + 1][0] if k + 1 < len(spots(p["html"], words.HEADING)) else end + 1000)]) for p in pages for k, (at, end, v) in enumerate(spots(p["html"], words.HEADING))]
    want = {(p, at, v, t[:600]) for (p, at, v, _), t in zip(heads, cleaned(spark, [h[3] for h in heads])) if t}
    assert {tuple(r) for r in words.headed_texts(spark, SF).collect()} == want and want


def test_sections(spark):
    want = {}
    for p in rows(spark, "pages"):
        section = None
        for m in re.finditer(r"(?is)<(?:h[1-6]|p)\b[^>]*>(?:(?!<h[1-6]\b|<p\b).)*", p["html"]):
            if re.match("(?i)<h[1-6]", m[0]):
                section = m[0]
            else:
                want[p["page_id"], section] = want.get((p["page_id"], section), 0) + 1
    names = sorted({s for _, s in want if s is not None})
    clean = dict(zip(names, cleaned(spark, names)))
    merged = {}
    for (page, s), n in want.items():
        merged[page, clean.get(s)] = merged.get((page, clean.get(s)), 0) + n
    assert {(r["page_id"], r["section"]): r["paragraphs"] for r in texts.html_sections(spark, SF).collect()} == merged


def test_greedy_folds_of_users(spark):
    users = {}
    for e in rows(spark, "events"):
        users.setdefault(e["user_id"], []).append((e["event_id"] * 1.0, e["event_id"] + e["value"] * 20, int(e["value"] // 10)))
    want = {(u, *x) for u, spans in users.items() for x in folds.trimmed(spans)}
    assert {(r["user_id"], r["a"], r["b"], r["anchors"]) for r in texts.trim_intervals(spark, SF).collect()} == want
    got = {}
    for r in texts.offset_groups(spark, SF).collect():
        got.setdefault(r["user_id"], []).append((r["t"], r["offset"], r["group"]))
    for u, own in got.items():
        own.sort()
        assert [g for *_, g in own] == folds.offset_groups([(t, o) for t, o, _ in own], 600, 8), u


def test_weighted_sample_ranks(spark):
    got = texts.weighted_sample(spark, SF).collect()
    parts = {r["p_partkey"]: r["p_size"] for r in rows(spark, "part")}
    assert len(got) == min(20, len(parts)) == len({r["p_partkey"] for r in got}) and all(parts[r["p_partkey"]] == r["p_size"] for r in got)
    assert sum(r["p_size"] for r in got) / len(got) > sum(parts.values()) / len(parts)  # larger parts are likelier
    assert texts.weighted_sample(spark, SF).collect() == got


def test_hashes_of_names(spark):
    names = {r["c_custkey"]: r["c_name"] for r in rows(spark, "customer")}

    def short(text):
        h = 5381
        for k in range(0, len(raw := text.encode("utf-16-be")), 2):
            h = (33 * h + int.from_bytes(raw[k : k + 2], "big")) % 2**32
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    got = {r["c_custkey"]: (r["name_hash"], r["visitor"]) for r in texts.hash_ids(spark, SF).collect()}
    assert got == {k: (short(n), hashlib.sha256(f"salt|{n}".encode()).hexdigest()[:32]) for k, n in names.items()}


def test_term_notes_of_tables(spark):
    from sparkloom.functions import notes

    m, want = notes.Matcher(words.RULES, words.FAMILIES), {}
    for t in [r["text"] for name in ("documents", "conversations") for r in rows(spark, name)]:
        for n in m.notes(t or ""):
            a, b = want.get(n["title"], (0, 0))
            want[n["title"]] = (a + 1, b + n["to"] - n["from"])
    assert {r["title"]: (r["notes"], r["chars"]) for r in words.term_notes(spark, SF).collect()} == want


def test_fixes_that_must_hold(spark):
    rows_ = spark.createDataFrame([("m", 1, 10.0, "Go, for it!"), ("m", 2, 50.0, "stay"), ("m", 3, None, "x")], "mission string, line int, g double, t string")
    own = spark.createDataFrame([("m", 1, 11.0, "gofor", 20.0), ("m", 2, 70.0, "STAY", 50.0), ("m", 3, 10.0, "nobody", 5.0), ("n", 4, 10.0, "go", 5.0)], "mission string, fix int, g double, t string, printed double")
    done, unmet = fixes.printed_times(rows_, own)
    assert sorted((r["line"], r["g"], r["fixed"]) for r in done.collect()) == [(1, 20.0, True), (2, 50.0, False), (3, None, False)]
    assert sorted(tuple(r) for r in unmet.collect()) == [("m", 3), ("n", 4)]
    with pytest.raises(ValueError, match="m: 3; n: 4"):
        fixes.require_met(unmet)
    fixes.require_met(unmet.limit(0))
