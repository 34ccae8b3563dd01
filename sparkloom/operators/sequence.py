"""Sequence operators over ordered rows: islands, runs, ties, interpolation, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def up_to_here(keys: list[str], order: list[str]):
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, to: str = "island") -> DataFrame:
    """Numbers stretches of rows; `breaks` says, of a row, that a new one starts there (the first row
    always does). Null counts as no."""
    first = F.row_number().over(ordered(keys, order)) == 1
    return df.withColumn("_new", (first | F.coalesce(breaks, F.lit(False))).cast("int")).withColumn(to, F.sum("_new").over(up_to_here(keys, order))).drop("_new")


def gap(keys: list[str], order: list[str], at: str) -> Column:
    return F.col(at) - F.lag(at).over(ordered(keys, order))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], values: list[str], start: str, end: str) -> DataFrame:
    """One row for each run of equal `values`: its first `start`, last `end` and number of rows."""
    w = ordered(keys, order)
    changed = ~F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values))
    return islands(df, keys, order, changed, "_run").groupBy(*keys, "_run").agg(*[F.first(v).alias(v) for v in values], F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n")).withColumnRenamed("_run", "run")


def spread_ties(df: DataFrame, keys: list[str], at: str, order: list[str], step: float, to: str = "spread") -> DataFrame:
    """Rows at one time are spread evenly up to the next time, or `step` apart after the last."""
    times = df.select(*keys, at).distinct()
    following = times.withColumn("_next", F.lead(at).over(ordered(keys, [at])))
    tie = Window.partitionBy(*keys, at)
    n, k = F.count("*").over(tie), F.row_number().over(tie.orderBy(*order)) - 1
    joined = df.withColumn("_n", n).withColumn("_k", k).join(following, [*keys, at])
    return joined.withColumn(to, F.when(F.col("_next").isNull(), F.col(at) + step * F.col("_k")).otherwise(F.col(at) + (F.col("_next") - F.col(at)) * F.col("_k") / F.col("_n"))).drop("_n", "_k", "_next")


def running_clamp(df: DataFrame, keys: list[str], order: list[str], value: str, to: str = "clamped") -> DataFrame:
    """Never less than any value before."""
    return df.withColumn(to, F.max(value).over(up_to_here(keys, order)))


def interpolate(df: DataFrame, keys: list[str], at: str, value: str, to: str = "value_at") -> DataFrame:
    """Nulls of `value` become the straight line between the known rows around them; before the
    first and after the last known row, its value."""
    w = ordered(keys, [at])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    back = Window.partitionBy(*keys).orderBy(F.desc(at))  # a frame to the end would be read again for each row
    a = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    line = a["y"] + (b["y"] - a["y"]) * (F.col(at) - a["x"]) / (b["x"] - a["x"])
    return df.withColumn(to, F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(line))


def carried(keys: list[str], order: list[str], value: Column) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, True).over(up_to_here(keys, order))


def context(df: DataFrame, keys: list[str], order: list[str], value: str, before: int = 2, after: int = 2) -> DataFrame:
    w = ordered(keys, order)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-before, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, after)))


def flagged_runs(df: DataFrame, keys: list[str], order: list[str], at: str, flag: Column, least_rows: int, least_span: float) -> DataFrame:
    """Runs of flagged rows that are long enough: keys, first, last, n."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    runs = run_lengths(marked, keys, order, ["_flag"], at, at)
    return runs.where(F.col("_flag") & (F.col("n") >= least_rows) & (F.col("last") - F.col("first") >= least_span)).select(*keys, "first", "last", "n")


def filled(df: DataFrame, day: str, keys: list[str], n: str, first: str, last: str) -> DataFrame:
    """Every day from first to last for each key, with 0 where df has none."""
    days = F.transform(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))), lambda d: d.cast("string"))
    frame = (df.select(*keys).distinct() if keys else df.sparkSession.range(1)).withColumn(day, F.explode(days))
    return frame.join(df, [*keys, day], "left").select(day, *keys, F.coalesce(n, F.lit(0)).alias(n))


def running_most(df: DataFrame, keys: list[str], at: str, value: Column, width: float, to: str, strict: bool = False) -> DataFrame:
    """The greatest value up to each row in order of `at` (strict: of the rows before it). The order is cut into buckets of `width`, and what earlier buckets reach is
    carried over, so that one key with very many rows is spread over tasks."""
    rows = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(at) / width))
    order = Window.partitionBy(*keys, "_b").orderBy(at)
    inside = order.rowsBetween(Window.unboundedPreceding, -1) if strict else order.rangeBetween(Window.unboundedPreceding, 0)
    most = rows.groupBy(*keys, "_b").agg(F.max("_v").alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried_ = most.select(*keys, "_b", F.max("_most").over(before).alias("_carry"))
    return rows.withColumn("_own", F.max("_v").over(inside)).join(carried_.hint("merge"), [*keys, "_b"]).withColumn(to, F.greatest("_own", "_carry")).select(*(c for c in df.columns if c != to), to)


def clusters(df: DataFrame, keys: list[str], start: str, end: Column, width: float, to: str = "cluster") -> DataFrame:
    """Rows whose spans overlap or touch, in chains: `to` is the start of the first one."""
    reached = running_most(df, keys, start, end, width, "_reached", strict=True)
    first = F.when(F.col("_reached").isNull() | (F.col(start) > F.col("_reached")), F.col(start))
    return running_most(reached.withColumn("_first", first), keys, start, F.col("_first"), width, to).drop("_reached", "_first")


def numbered(df: DataFrame, keys: list[str], at: str, ties: list[str], width: float, to: str) -> DataFrame:
    """Numbers the rows of each key from 0 in order of `at` and `ties`. Rows are numbered by buckets of
    `width`, and the counts of earlier buckets added, so that no key is ordered in one task."""
    rows = df.withColumn("_b", F.floor(F.col(at) / width))
    many = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = many.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(at, *ties))
    return rows.withColumn("_own", own).join(base.hint("merge"), [*keys, "_b"]).withColumn(to, F.col("_base") + F.col("_own") - 1).select(*df.columns, to)
