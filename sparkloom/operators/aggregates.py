"""Aggregations with stated ties: modes, votes, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str, to: str = "mode") -> DataFrame:
    """The most common value of each key; of equally common ones the one seen first in `order`.
    Counted in two steps, so a key with very many rows is pre-aggregated."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(to))


def clipped_fit(df: DataFrame, keys: list[str], x: str, y: str, least_spread: float, most_slope: float) -> DataFrame:
    """Least-squares slope, clipped, where x is spread enough (else 0), and the median intercept."""
    slope = F.when(F.max(x) - F.min(x) > least_spread, F.greatest(F.least(F.regr_slope(y, x), F.lit(most_slope)), F.lit(-most_slope))).otherwise(0.0)
    fits = df.groupBy(*keys).agg(F.coalesce(slope, F.lit(0.0)).alias("slope"))
    return df.join(fits, keys).groupBy(*keys, "slope").agg(F.median(F.col(y) - F.col("slope") * F.col(x)).alias("intercept"), F.count("*").alias("n"))


def rare_votes(queries: DataFrame, index: DataFrame, query: str, gram: str, place: str, most: int, width: float, least: float = 0.0) -> DataFrame:
    """Each distinct gram of a query votes 1/hits for the places (in bins) where the index has it, if
    it has at most `most`. The best bin of each query, the lower of equals, and its score. Index rows
    whose gram no query has go before anything is counted. Both sides are dealt out by grams; hits are
    counted where the rows lie, so that the index is made and dealt out once. Neither side is sent whole:
    the grams of a small file are many."""
    asked = queries.select(query, gram).repartition(gram).distinct().hint("merge")
    met = index.join(asked.select(gram).hint("merge"), gram, "left_semi")
    rare = met.withColumn("_hits", F.count("*").over(Window.partitionBy(gram))).where(F.col("_hits") <= most)
    votes = asked.join(rare, gram).withColumn("bin", F.floor(F.col(place) / width).cast("long")).groupBy(query, "bin").agg(F.sum(1 / F.col("_hits")).alias("score"))
    best = votes.groupBy(query).agg(F.max_by("bin", F.struct(F.round("score", 6), -F.col("bin"))).alias("bin"), F.round(F.max("score"), 2).alias("score"))
    return best.where(F.col("score") >= least)


def majority(flag: Column) -> Column:
    return F.count_if(flag) * 2 > F.count("*")
