"""Intervals: covered length, overlap with fixed buckets, replacement of a stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_per_bucket(df: DataFrame, keys: list[str], start: str, end: str, width: float, least: float = 0.0) -> DataFrame:
    """keys, bucket and the summed length that the intervals have in it; from `least` on."""
    spots = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    each = df.where(F.col(end) > F.col(start)).withColumn("bucket", F.explode(spots))
    a, b = F.col("bucket") * width, (F.col("bucket") + 1) * width
    length = F.greatest(F.lit(0), F.least(F.col(end), b) - F.greatest(F.col(start), a))
    return each.groupBy(*keys, "bucket").agg(F.sum(length).alias("length")).where((F.col("length") >= least) & (F.col("length") > 0))


def covered(start: Column, end: Column, rate: Column | float = 1.0) -> Column:
    """Summed length of intervals that do not overlap."""
    return F.sum((end - start) * rate)


def pinned(pieces: DataFrame, pins: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Each pin replaces what it covers: pieces are cut to both sides of it, with `at` (the value at
    the start, of slope one) moved along, and the pin is put in. Pins of a key do not overlap."""
    cut = pieces.join(pins.select(F.col(key).alias("_k"), F.col(start).alias("_a"), F.col(end).alias("_b")), (F.col(key) == F.col("_k")) & (F.col("_a") < F.col(end)) & (F.col(start) < F.col("_b")), "left")
    hit = cut.where("_k is not null").groupBy(key, start, end, at).agg(F.array_sort(F.collect_list(F.struct("_a", "_b"))).alias("_p"))
    # The free stretches of a piece: from its start, and from each pin's end, to the next pin or its end.
    froms = F.concat(F.array(F.col(start)), F.transform("_p", lambda p: p["_b"]))
    tos = F.concat(F.transform("_p", lambda p: p["_a"]), F.array(F.col(end)))
    free = hit.select(key, start, at, F.explode(F.arrays_zip(froms.alias("f"), tos.alias("t"))).alias("s"))
    rest = free.where("s.f < s.t").select(key, F.col("s.f").alias("_f"), F.col("s.t").alias("_t"), (F.col(at) + F.col("s.f") - F.col(start)).alias("_at"))
    whole = cut.where("_k is null").select(key, F.col(start).alias("_f"), F.col(end).alias("_t"), F.col(at).alias("_at"))
    new = pins.select(key, F.col(start).alias("_f"), F.col(end).alias("_t"), F.col(at).alias("_at"))
    return rest.unionByName(whole).unionByName(new).select(key, F.col("_f").alias(start), F.col("_t").alias(end), F.col("_at").alias(at))
