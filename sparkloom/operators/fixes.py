"""Hand fixes applied to lines: matched by time and text, folded in the order of their list.

A fix matches all lines within `close` seconds whose text it names (or any, if it names none); a fix
that matches none goes to the nearest line within `far` seconds. Matching is joins; the fold over the
few fixes of a line is an array aggregate, so no line leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins


def matched(lines: DataFrame, fixes: DataFrame, close: float = 2, far: float = 3600) -> DataFrame:
    """lines: mission, line, g, s, t. fixes: mission, fix, g, from (may be null), and others.
    Returns mission, line and fix of each match."""
    f = fixes.select("mission", "fix", F.col("g").alias("_g"), F.col("from").alias("_from"))
    named = F.col("_from").isNull() | F.contains(F.col("t"), F.col("_from"))
    near = joins.band_join(f, lines.select("mission", "line", "g", "t"), ["mission"], "_g", "g", close, close).where(named).select("mission", "line", "fix")
    rest = f.join(near.select("mission", "fix").distinct(), ["mission", "fix"], "left_anti").select("mission", "fix", "_g", "_from")
    reach = joins.band_join(rest, lines.select("mission", "line", "g", "t"), ["mission"], "_g", "g", far, far).where(named)
    one = reach.groupBy("mission", "fix").agg(F.min_by("line", F.struct(F.abs(F.col("g") - F.col("_g")), "g", "line")).alias("line"))
    return near.unionByName(one.select("mission", "line", "fix"))


def applied(lines: DataFrame, fixes: DataFrame, close: float = 2, far: float = 3600) -> DataFrame:
    """Lines after their fixes. A fix has the columns verb (replace, set, delete, ok, unheard,
    retime), from, to, speaker, at. A deleted line stays deleted whatever comes later."""
    m = matched(lines, fixes, close, far).join(fixes.select("mission", "fix", "verb", "from", "to", "speaker", "at"), ["mission", "fix"])
    todo = m.groupBy("mission", "line").agg(F.array_sort(F.collect_list(F.struct("fix", "verb", "from", "to", "speaker", "at"))).alias("_fixes"))
    start = F.struct(F.col("g").cast("double").alias("g"), F.col("s").alias("s"), F.col("t").alias("t"), F.lit(False).alias("ok"), F.lit(False).alias("unheard"), F.lit(False).alias("gone"))

    def step(x, f):
        v = f["verb"]
        return F.struct(
            F.when(v == "retime", f["at"]).otherwise(x["g"]).alias("g"),
            F.when((v == "set") & f["speaker"].isNotNull(), f["speaker"]).otherwise(x["s"]).alias("s"),
            F.when((v == "replace") & f["from"].isNotNull(), F.replace(x["t"], f["from"], F.coalesce(f["to"], F.lit("")))).when((v == "set") & f["to"].isNotNull(), f["to"]).otherwise(x["t"]).alias("t"),
            (x["ok"] | (v == "ok")).alias("ok"),
            (x["unheard"] | (v == "unheard")).alias("unheard"),
            (x["gone"] | (v == "delete")).alias("gone"),
        )

    out = lines.join(todo, ["mission", "line"], "left").withColumn("_x", F.when(F.col("_fixes").isNull(), start).otherwise(F.aggregate("_fixes", start, step)))
    return out.where(~F.col("_x.gone")).select("mission", "line", *(F.col(f"_x.{c}").alias(c) for c in ("g", "s", "t", "ok", "unheard")))


def unmatched(lines: DataFrame, fixes: DataFrame, close: float = 2, far: float = 3600) -> DataFrame:
    """Fixes that no line takes; a strict run stops if there are any."""
    return fixes.join(matched(lines, fixes, close, far).select("mission", "fix").distinct(), ["mission", "fix"], "left_anti")


def parted(lines: DataFrame, fixes: DataFrame, close: float = 2, far: float = 3600) -> DataFrame:
    """Lines cut in two where, after its first letter, a line holds the fix's `to`; the second part is
    `speaker`'s. A line may be cut at several places; of cuts at one place the last fix counts. Returns
    mission, line, part (0, 1, ...), g, s, t; a fix whose `to` is not there does nothing."""
    m = matched(lines, fixes, close, far).join(fixes.select("mission", "fix", "to", "speaker"), ["mission", "fix"])
    cuts = m.join(lines.select("mission", "line", "t"), ["mission", "line"]).withColumn("at", F.expr("locate(`to`, t, 2)")).where("at > 0")
    by_line = cuts.groupBy("mission", "line").agg(F.array_sort(F.collect_list(F.struct("at", "fix", "speaker"))).alias("_cuts"))
    own = F.array(F.struct(F.lit(1).alias("at"), F.lit(None).cast("long").alias("fix"), F.col("s").alias("speaker")))
    all_cuts = lines.join(by_line, ["mission", "line"], "left").withColumn("_cuts", F.when(F.col("_cuts").isNull(), own).otherwise(F.concat(own, "_cuts")))
    parts = all_cuts.select("mission", "line", "g", "s", "t", "_cuts", F.posexplode("_cuts").alias("_k", "_cut"))
    following = F.coalesce(F.get("_cuts", F.col("_k") + 1)["at"], F.length("t") + 1)
    text = F.when(F.size("_cuts") > 1, F.trim(F.substring("t", F.col("_cut.at"), following - F.col("_cut.at")))).otherwise(F.col("t"))
    rows = parts.select("mission", "line", "_k", "g", F.col("_cut.speaker").alias("s"), text.alias("t")).where((F.col("_k") == 0) | (F.col("t") != ""))
    numbered = rows.groupBy("mission", "line", "g").agg(F.array_sort(F.collect_list(F.struct("_k", "s", "t"))).alias("_rows"))
    return numbered.select("mission", "line", "g", F.posexplode("_rows").alias("part", "_r")).select("mission", "line", "part", "g", F.col("_r.s").alias("s"), F.col("_r.t").alias("t"))


def rejoined(lines: DataFrame, fixes: DataFrame, close: float = 2, far: float = 3600, reach: float = 120) -> DataFrame:
    """Lines joined again that a scan broke in two: the nearest other line within `reach` seconds that
    starts with the fix's `to` goes to the end of the line that the fix matches, and is gone. A line
    goes to the first fix that wants it. One that goes takes none itself, so a chain takes a call for
    each of its links."""
    m = matched(lines, fixes, close, far).join(fixes.select("mission", "fix", "to"), ["mission", "fix"])
    heads = m.join(lines.select("mission", "line", F.col("g").alias("_g")), ["mission", "line"]).withColumnRenamed("line", "_head")
    near = joins.band_join(heads, lines.select("mission", "line", "g", "t"), ["mission"], "_g", "g", reach, reach)
    wanted = near.where((F.col("line") != F.col("_head")) & F.startswith("t", F.col("to")))
    tails = wanted.groupBy("mission", "fix", "_head").agg(F.min_by(F.struct("line", "t"), F.struct(F.abs(F.col("g") - F.col("_g")), "g", "line")).alias("_tail"))
    given = tails.groupBy("mission", F.col("_tail.line").alias("line")).agg(F.min_by(F.struct("fix", "_head", "_tail.t"), F.struct("fix", "_head")).alias("_to"))
    free = given.alias("a").join(given.alias("b"), (F.col("a.mission") == F.col("b.mission")) & (F.col("a._to._head") == F.col("b.line")), "left_anti")
    more = free.groupBy("mission", F.col("_to._head").alias("line")).agg(F.array_sort(F.collect_list(F.struct("_to.fix", "line", "_to.t"))).alias("_more"))
    kept = lines.join(free.select("mission", "line"), ["mission", "line"], "left_anti").join(more, ["mission", "line"], "left")
    whole = F.concat_ws(" ", F.concat(F.array(F.rtrim("t")), F.transform("_more", lambda x: F.ltrim(x["t"]))))
    return kept.withColumn("t", F.when(F.col("_more").isNull(), F.col("t")).otherwise(whole)).select(*lines.columns)


def _plain(text: str) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def printed_times(rows: DataFrame, fixes: DataFrame, close: float = 2) -> tuple[DataFrame, DataFrame]:
    """Printed times put right before anything is timed. rows: mission, line, g, t; fixes: mission, fix, g (as
    read), t (part of the line), printed. Rows of a fix are those within `close` seconds whose letters and
    digits hold the fix's; of several fixes of a row the last counts. Returns the rows, with `g` put right
    and `fixed`, and the fixes that have no row and do not already hold: no row of that text has the time."""
    f = fixes.select("mission", "fix", F.col("g").cast("double").alias("_g"), _plain("t").alias("_own"), F.col("printed").cast("double").alias("printed"))
    r = rows.where("g is not null").select("mission", "line", F.col("g").cast("double").alias("g"), _plain("t").alias("_text"))
    holds = F.contains(F.col("_text"), F.col("_own"))
    hits = joins.band_join(f, r, ["mission"], "_g", "g", close, close).where(holds)
    new = hits.groupBy("mission", "line").agg(F.max_by("printed", "fix").alias("_new"))
    rest = f.join(hits.select("mission", "fix").distinct(), ["mission", "fix"], "left_anti")
    already = joins.band_join(rest, r, ["mission"], "printed", "g", 0, 0).where(holds).select("mission", "fix").distinct()
    out = rows.join(new, ["mission", "line"], "left").withColumn("fixed", F.col("_new").isNotNull()).withColumn("g", F.coalesce("_new", F.col("g").cast("double")))
    return out.select(*rows.columns, "fixed"), rest.join(already, ["mission", "fix"], "left_anti").select("mission", "fix")


def require_met(unmet: DataFrame, some: int = 20) -> None:
    """Raises if a fix found no line; names some of them."""
    names = [f"{r[0]}: {r[1]}" for r in unmet.orderBy("mission", "fix").limit(some).collect()]
    if names:
        raise ValueError("fixes without a line: " + "; ".join(names))
