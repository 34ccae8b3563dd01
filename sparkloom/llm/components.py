"""Connected components of a link table, by alternating star contractions.

Each round hangs the neighbours of a node on the least node around it (first those above the node,
then those below), until nothing changes; depth shrinks geometrically. Only minima are aggregated,
so a node with very many links needs no list of them. Rounds are cut by stored tables, of which only
the last stays. No links: no nodes. Repeated links and links to oneself add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any orderable type. Returns node, root for each node that has a link; root is
    the least node of its component. The result can be dropped like a stored table."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each node's greater neighbours go to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node and its lesser neighbours go to the least of those.
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
        small = large.join(lowest, F.col("a") == F.col("v")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = stored(small, "links")
        drop_stored(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._stored_at = edges._stored_at
    return out
