"""Resharding by minimum-cost flow: from old shards to new ones, moving the fewest bytes.

Rows of an old shard are put into blocks by size class: powers of two, where the one that an old
shard's surplus ends in is parted at that very size. Sources of the flow are the (old shard, size
class) pairs with their row counts, sinks are the new shards with their capacities in rows; a row
that stays costs nothing, one that moves costs the mean bytes of its class. As only a class of equal
sizes is ever cut, the moved bytes are the fewest for the rows' own sizes. Blocks then follow the
flow: most go whole, a few are cut at a row number. `rewrite` writes the files of those shards whose
rows change.

The law is `rows`: the row counts of the new shards differ by at most one. Rows are shuffled once, by
block, with all columns that are to be kept, and are written from there, so a shard is written by many
tasks. The driver holds one line for each block of about `block_rows` rows.

Null text has no bytes. Repeated rows are rows, and so are rows with a null id. An empty table has no
assignment. Rows are ordered within a block by size, id and a hash of the text; equal rows may stand
in either order. Columns of any name may be kept.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OLD_SHARDS, NEW_SHARDS = 16, 24
BLOCK_ROWS, BLOCK_BYTES = 100_000, 256 << 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def flow(supplies: dict[tuple[int, int], tuple[int, float]], old: int, new: int) -> dict[tuple[int, int], dict[int, int]]:
    """supplies: (old shard, class) -> rows, mean bytes. Returns rows from each to each new shard.

    Successive cheapest paths. As a moved row costs the same wherever it goes, moves share one
    middle node, which keeps the graph at a few edges for each source."""
    total = sum(n for n, _ in supplies.values())
    base, extra = divmod(total, new)
    nodes: dict = {}
    at = lambda x: nodes.setdefault(x, len(nodes))
    to, room, cost, out = [], [], [], {}

    def edge(a, b, n, c):
        for u, v, r, w in ((a, b, n, c), (b, a, 0, -c)):
            out.setdefault(at(u), []).append(len(to))
            to.append(at(v))
            room.append(r)
            cost.append(w)
        return len(to) - 2

    stay, move = {}, {}
    for (i, c), (n, mean) in sorted(supplies.items()):
        edge("source", (i, c), n, 0)
        if i < new:
            stay[i, c] = edge((i, c), ("new", i), n, 0)
        move[i, c] = edge((i, c), "moved", n, mean)
    dealt = {}
    for j in range(new):
        dealt[j] = edge("moved", ("new", j), total, 0)
        edge(("new", j), "sink", base, 0)
        edge(("new", j), "one more", 1, 0)
    edge("one more", "sink", extra, 0)
    s, t = at("source"), at("sink")
    while True:
        far, by, queue, waiting = {s: 0.0}, {}, deque([s]), {s}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in out.get(u, ()):
                if room[e] and far[u] + cost[e] < far.get(to[e], float("inf")) - 1e-9:
                    far[to[e]], by[to[e]] = far[u] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if t not in far:
            break
        path, v = [], t
        while v != s:
            path.append(by[v])
            v = to[by[v] ^ 1]
        n = min(room[e] for e in path)
        for e in path:
            room[e] -= n
            room[e ^ 1] += n
    taken = deque((j, room[e ^ 1]) for j, e in dealt.items() if room[e ^ 1])
    result = {}
    for key in sorted(supplies):
        parts = {}
        n = room[move[key] ^ 1]
        while n:
            j, left = taken.popleft()
            part = min(n, left)
            parts[j] = parts.get(j, 0) + part
            n -= part
            if left > part:
                taken.appendleft((j, left - part))
        if key in stay and room[stay[key] ^ 1]:  # last, as row numbers rise with size
            parts[key[0]] = parts.get(key[0], 0) + room[stay[key] ^ 1]
        result[key] = parts
    return result


def cuts(blocks: list[tuple[int, int, int, int, int]], new: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """blocks: old shard, class, part, rows, bytes. Returns old shard, class, part, first and last
    row number, new shard, slot of the first row."""
    sums: dict[tuple[int, int], list[int]] = {}
    for i, c, _, n, b in blocks:
        got = sums.setdefault((i, c), [0, 0])
        got[0] += n
        got[1] += b
    go = flow({k: (n, b / n) for k, (n, b) in sums.items()}, 0, new)
    left = {k: deque(v.items()) for k, v in go.items()}
    used = [0] * new
    out = []
    for i, c, part, n, _ in sorted(blocks):
        first = 1
        while n:
            j, want = left[i, c].popleft()
            take = min(n, want)
            if want > take:
                left[i, c].appendleft((j, want - take))
            out.append((i, c, part, first, first + take - 1, j, used[j]))
            used[j] += take
            first += take
            n -= take
    return out


def surplus_ends(rows: DataFrame, totals: list, new: int) -> list[tuple[int, int]]:
    """Old shard and size of the last row that it gives away, smallest first, if it keeps no extra row."""
    spark, sums = rows.sparkSession, {}
    for r in totals:
        sums.setdefault(r["old_shard"], []).append((r["_class"], r["n"]))
    base = sum(n for classes in sums.values() for _, n in classes) // new
    wanted = []
    for i, classes in sums.items():
        left = sum(n for _, n in classes) - base
        if i < new and left > 0:
            for c, n in sorted(classes):
                if left <= n:
                    wanted.append((i, c, left))
                    break
                left -= n
    if not wanted:
        return []
    at = spark.createDataFrame(wanted, "old_shard int, _class int, _rank long")
    sizes = rows.join(F.broadcast(at), ["old_shard", "_class"]).groupBy("old_shard", "_rank", "size").count()
    sizes = sizes.withColumn("upto", F.sum("count").over(Window.partitionBy("old_shard").orderBy("size")))
    return [(r["old_shard"], r["size"]) for r in sizes.where((F.col("upto") >= F.col("_rank")) & (F.col("upto") - F.col("count") < F.col("_rank"))).collect()]


def reshard(df: DataFrame, old_shard: Column, size: Column, key: str = "doc_id", text: str = "text", new: int = NEW_SHARDS, block_rows: int = BLOCK_ROWS, keep: dict[str, Column] | None = None) -> tuple[DataFrame, list[int]]:
    """Returns key, size, old_shard, shard, slot and the columns of `keep` for each row; and the
    numbers of the shards, old and new, whose rows change."""
    spark: SparkSession = df.sparkSession
    kept = {f"kept{k}": name for k, name in enumerate(keep or {})}
    rows = df.select(F.col(key).alias("key"), size.alias("size"), old_shard.cast("int").alias("old_shard"), F.xxhash64(F.col(key), F.col(text)).alias("_tie"), *(c.alias(f"kept{k}") for k, c in enumerate((keep or {}).values())))
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("size"))).cast("int"))
    totals = rows.groupBy("old_shard", "_class").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    # A class of very many rows or bytes is dealt out to parts.
    parts = [(r["old_shard"], r["_class"], max(1, -(-r["n"] // block_rows), -(-r["b"] // BLOCK_BYTES))) for r in totals]
    parts = spark.createDataFrame(parts, "old_shard int, _class int, _parts int")
    ends = spark.createDataFrame(surplus_ends(rows, totals, new), "old_shard int, _end long")
    rows = rows.join(F.broadcast(parts), ["old_shard", "_class"]).withColumn("_part", F.pmod(F.col("_tie"), F.col("_parts")).cast("int")).drop("_parts")
    rows = rows.join(F.broadcast(ends), "old_shard", "left").withColumn("_class", F.col("_class") * 3 + F.coalesce(F.signum(F.col("size") - F.col("_end")).cast("int") + 1, F.lit(0))).drop("_end")
    block = ["old_shard", "_class", "_part"]
    lines = cuts([tuple(r) for r in rows.groupBy(*block).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()], new)
    plan = spark.createDataFrame(lines, "old_shard int, _class int, _part int, _first long, _last long, shard int, _slot long")
    at = F.row_number().over(Window.partitionBy(*block).orderBy("size", "key", "_tie")).cast("long")
    out = (
        rows.withColumn("_at", at)
        .join(F.broadcast(plan), block)
        .where(F.col("_at").between(F.col("_first"), F.col("_last")))
        .select(F.col("key").alias(key), "size", "old_shard", "shard", (F.col("_slot") + F.col("_at") - F.col("_first")).alias("slot"), *(F.col(k).alias(name) for k, name in kept.items()))
    )
    return out, sorted({x for i, _, _, _, _, j, _ in lines if i != j for x in (i, j)})


def rewrite(rows: DataFrame, changed: list[int], path: str) -> None:
    """Writes the rows of the changed shards, and of no others, under path/shard=N, in order of slots
    within a file. Untouched shards keep the files that they have."""
    part = rows.where(F.col("shard").isin(changed))
    part.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
