"""Joins on a clock: as-of, nearest, band, interval, and snapshot comparison.

None of them compares all pairs. As-of joins are a union and a window; the window is cut into time
buckets, with the last row of earlier buckets carried over, so that a key with very many rows is
spread over tasks. Band and interval joins put rows into fixed-width buckets and equi-join on these.
What grows with the input is never broadcast (hint `merge`): Spark judges a table by its size before its
rows are unfolded into buckets, and the driver would hold all of them. Times are numbers: seconds, or microseconds of the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str], width: float, forward: bool = False, strict: bool = False, to: str = "match") -> DataFrame:
    """Adds `to`: a struct of right_at and `take` of the right row with the greatest right_at <= at
    (forward: the least >= at; strict: not the same time), or null. Of right rows at one time the one
    with the greatest (forward: least) `take` is chosen. `width` is the time that a bucket covers."""
    sign = -1 if forward else 1
    payload = F.struct(F.col(right_at), *take)
    order = [(F.col("_t") * sign).asc(), F.col("_side").asc()]
    # At one time: right rows first, so that a left row sees them; last if the time must differ.
    l = left.select(*left.columns, F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    r = right.select(*[F.col(k) for k in keys], F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_p"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    tie = [F.col("_p").asc() if not forward else F.col("_p").desc()]
    inside = Window.partitionBy(*keys, "_b").orderBy(*order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    has = F.col("_p").isNotNull()  # rows without an order are passed over
    pick = F.min_by("_p", F.when(has, F.struct("_t", "_p"))) if forward else F.max_by("_p", F.when(has, F.struct("_t", "_p")))
    buckets = both.groupBy(*keys, "_b").agg(pick.alias("_end"))
    before = Window.partitionBy(*keys).orderBy((F.col("_b") * sign).asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_carry", F.last("_end", True).over(before)).select(*keys, "_b", "_carry")
    seen = both.withColumn("_own", F.last("_p", True).over(inside)).where(F.col("_p").isNull())
    return seen.join(carried.hint("merge"), [*keys, "_b"], "left").withColumn(to, F.coalesce("_own", "_carry")).select(*left.columns, to)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str], width: float, tolerance: float | None = None, to: str = "match") -> DataFrame:
    """The right row nearest in time, before or after; a tie goes to the earlier one. Beyond
    `tolerance` the match is null. Of right rows at one time, the greatest `take` counts before, the
    least after. One pass: both sides come from one union, dealt out once."""
    payload = F.struct(F.col(right_at), *take)
    l = left.select(*left.columns, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    r = right.select(*[F.col(k) for k in keys], F.col(right_at).alias("_t"), F.lit(1).alias("_side"), payload.alias("_p"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    # At one time left rows come first, so that right rows of that time count as after.
    inside = Window.partitionBy(*keys, "_b")
    up, down = inside.orderBy("_t", "_side", "_p"), inside.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_p"))
    so_far = (Window.unboundedPreceding, 0)
    has = F.when(F.col("_p").isNotNull(), F.struct("_t", "_p"))
    buckets = both.groupBy(*keys, "_b").agg(F.max_by("_p", has).alias("_end"), F.min_by("_p", has).alias("_begin"))
    line = Window.partitionBy(*keys)
    others = buckets.select(*keys, "_b", F.last("_end", True).over(line.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_old"), F.last("_begin", True).over(line.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_new"))
    seen = both.withColumn("_back", F.last("_p", True).over(up.rowsBetween(*so_far))).withColumn("_ahead", F.last("_p", True).over(down.rowsBetween(*so_far))).where("_side = 0")
    out = seen.join(others.hint("merge"), [*keys, "_b"], "left").withColumn("_back", F.coalesce("_back", "_old")).withColumn("_ahead", F.coalesce("_ahead", "_new"))
    back, ahead = F.col(at) - F.col("_back")[right_at], F.col("_ahead")[right_at] - F.col(at)
    best = F.when(F.col("_ahead").isNull() | (back <= ahead), F.col("_back")).otherwise(F.col("_ahead"))
    out = out.withColumn(to, best)
    if tolerance is not None:
        out = out.withColumn(to, F.when(F.abs(F.col(at) - F.col(to)[right_at]) <= tolerance, F.col(to)))
    return out.select(*left.columns, to)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, before: float, after: float) -> DataFrame:
    """All pairs with equal keys and at - before <= right_at <= at + after. Buckets are as wide as
    the band, so each left row is looked up in at most three."""
    width = float(before + after) or 1.0
    spots = F.sequence(F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width))
    l = left.withColumn("_b", F.explode(spots))
    r = right.withColumn("_b", F.floor(F.col(right_at) / width))
    return l.join(r, [*keys, "_b"]).where(F.col(right_at).between(F.col(at) - before, F.col(at) + after)).drop("_b")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """All pairs with equal keys and start <= at < end. A span is looked up in each bucket of `width`
    that it touches: choose about the usual length of a span."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(s.hint("merge"), [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """key and change: added, modified (another version) or removed."""
    o, n = old.select(F.col(key), F.col(version).alias("_o"), F.lit(1).alias("_ho")), new.select(F.col(key), F.col(version).alias("_n"), F.lit(1).alias("_hn"))
    change = F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return o.join(n, key, "full").select(key, change.alias("change")).where("change is not null")


def cogrouped(left: DataFrame, right: DataFrame, keys: list[str], fold, schema: str) -> DataFrame:
    """fold(rows of left, rows of right) of each key. Both sides may come from one table."""
    own = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(fold, schema)
