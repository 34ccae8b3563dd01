"""Longest runs and chains of a stream, exact, where one key may hold most of all rows.

Keys of up to `block` rows are folded in one task each (`folds.increasing`, `folds.chain`). A larger
key is cut twice, into stretches of its order and into ranges of its values; a cell is what lies in
both. Patience sorting composes over cells: a range keeps the tails that lie in it, a row in it takes
the place of the next greater tail, and if its range has none, the row's place goes up as an event that
takes the least tail of the first range above that has any. So a cell needs the tails of its range from
the stretch before, and the events of its stretch from the range below, and hands on both. The events
that have come up count the tails below, which gives each row its rank: the length of the longest run
that ends there. Cells on a diagonal do not need each other and run side by side; there is one Spark
job for each diagonal, over all keys at once.

The run itself is read backwards: the last row of the greatest rank, then the last row before it of the
next lower rank, and so on. For each stretch, a table says for each rank sought on entry which rank is
still sought on leaving it; the way back goes through these tables with one row a key, and each stretch
then marks its rows by itself. No task holds more than a stretch's rows, a range's tails and a
stretch's events.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored
from .folds import by_rows, chain, increasing, resolved

#: Rows of a stretch, and of a key that one task folds.
BLOCK = 200_000
#: Large keys that may be broadcast (a few bytes each).
SPREAD = 100_000
_POINT, _TAILS, _EVENTS, _RANKS = range(4)
_CELL = ["_k", "_mi", "_mj", "_bi", "_bj"]
_ROWS = "_k long, _mi int, _mj int, _bi int, _bj int, _kind int, _n long, _data array<bigint>, _ranks array<bigint>, _ys array<bigint>"


def cell(tails: list[int], below: int, events: list[int], points: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Ranks of the points (place, height; in order of place), the tails afterwards and the events that
    go up. events: places at which ranges below have run out of tails, `below` their number before."""
    tails, head, at, up, ranks = list(tails), 0, 0, [], []
    for x, y in points:
        while at < len(events) and events[at] < x:
            if head < len(tails):
                head += 1
            else:
                up.append(events[at])
            at += 1
        k = bisect_right(tails, y, head)
        ranks.append(below + at + k - head + 1)
        if k < len(tails):
            tails[k] = y
        else:
            tails.append(y)
            up.append(x)
    rest = events[at:]
    taken = min(len(rest), len(tails) - head)
    return ranks, tails[head + taken :], up + rest[taken:]


def _cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    k, mi, mj, bi, bj = (v.as_py() for v in key)
    kinds = table.column("_kind").to_numpy()
    take = lambda kind: table.filter(pa.array(kinds == kind))
    own, left, low = take(_POINT), take(_TAILS), take(_EVENTS)
    points = sorted(zip(own.column("_data")[0].as_py(), own.column("_ys")[0].as_py())) if own.num_rows else []
    tails = left.column("_data")[0].as_py() if left.num_rows else []
    below = left.column("_n")[0].as_py() if left.num_rows else 0
    events = low.column("_data")[0].as_py() if low.num_rows else []
    ranks, tails, up = cell(tails, below, events, points)
    out = []
    if points:
        out.append((bi, bj, _RANKS, 0, [x for x, _ in points], ranks, [y for _, y in points]))
    below += len(events)
    if bi + 1 < mi and (tails or below):
        out.append((bi + 1, bj, _TAILS, below, tails, None, None))
    if bj + 1 < mj and up:
        out.append((bi, bj + 1, _EVENTS, 0, up, None, None))
    columns = list(zip(*out)) if out else [[]] * 7
    n, longs = len(out), pa.list_(pa.int64())
    number = lambda v, t: pa.array([v] * n, t)
    return pa.table(
        [number(k, pa.int64()), number(mi, pa.int32()), number(mj, pa.int32()), *(pa.array(c, pa.int32()) for c in columns[:3])]
        + [pa.array(columns[3], pa.int64()), *(pa.array(c, longs) for c in columns[4:])],
        names=[*_CELL, "_kind", "_n", "_data", "_ranks", "_ys"],
    )


def _ranked(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """points: _k, _i, _j (stretch and range), _x, _y. Adds _bi, _bj (counted from 0 for each key) and
    _rank; and the tables that it reads."""
    bounds = stored(points.groupBy("_k").agg(F.min("_i").alias("_i0"), F.min("_j").alias("_j0"), (F.max("_i") - F.min("_i") + 1).alias("_mi"), (F.max("_j") - F.min("_j") + 1).alias("_mj")), "bounds")
    placed = points.join(bounds if bounds.count() > SPREAD else F.broadcast(bounds), "_k").withColumns({"_bi": F.col("_i") - F.col("_i0"), "_bj": F.col("_j") - F.col("_j0")})
    # One row a cell: Arrow rows with array columns take far longer to send than the cell to fold.
    whole = placed.groupBy(*_CELL).agg(F.collect_list("_x").alias("_data"), F.collect_list("_y").alias("_ys"))
    cells = stored(whole.select(*_CELL, (F.col("_bi") + F.col("_bj")).alias("_d"), "_data", "_ys").repartition("_d", "_k"), "cells", by=["_d"])
    last = bounds.agg(F.max(F.col("_mi") + F.col("_mj"))).first()[0] - 2
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rounds: list[DataFrame] = []
    for d in range(last + 1):
        rows = cells.where(F.col("_d") == d).select(*_CELL, F.lit(_POINT).alias("_kind"), F.lit(None).cast("long").alias("_n"), "_data", F.lit(None).cast("array<bigint>").alias("_ranks"), "_ys")
        if rounds:
            rows = rows.unionByName(rounds[-1].where(F.col("_kind") != _RANKS))
        # Cells are few bytes and much work: adaptive execution would give them all to a task or two.
        rows = rows.repartition(tasks, *_CELL)
        rounds.append(stored(rows.groupBy(*_CELL).applyInArrow(_cell, _ROWS), "diagonal"))
    found = spark.read.schema(rounds[0].schema).parquet(*[r._stored_at for r in rounds]).where(F.col("_kind") == _RANKS)
    each = found.select("_k", "_bi", "_bj", F.explode(F.arrays_zip("_data", "_ys", "_ranks")).alias("p"))
    return each.select("_k", "_bi", "_bj", F.col("p._data").alias("_x"), F.col("p._ys").alias("_y"), F.col("p._ranks").alias("_rank")), [bounds, cells, *rounds]


def _leaving(p: pd.DataFrame) -> pd.DataFrame:
    sought: dict[int, int] = {}
    for r in p.sort_values("_at")["_rank"].tolist():
        sought[r] = sought.get(r - 1, r - 1)
    return pd.DataFrame({"_k": p["_k"].iloc[0], "_b": p["_b"].iloc[0], "_rank": list(sought), "_left": list(sought.values())})


def _marked(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("_at", ascending=False)
    sought, out = int(p["_sought"].iloc[0]), []
    for x, r in zip(p["_x"].tolist(), p["_rank"].tolist()):
        if r == sought:
            out.append(x)
            sought -= 1
    return pd.DataFrame({"_x": pd.Series(out, dtype="int64")})


def _read_back(ranks: DataFrame, stretch: str, at: str) -> DataFrame:
    """_x of the rows of one longest run of each key, read backwards along `at` by stretches."""
    spark = ranks.sparkSession
    rows = stored(ranks.select("_k", F.col(stretch).alias("_b"), F.col(at).alias("_at"), "_x", "_rank"), "ranks")
    leaving = stored(rows.groupBy("_k", "_b").applyInPandas(_leaving, "_k long, _b int, _rank long, _left long").repartition("_b"), "leaving", by=["_b"])
    sought = {r["_k"]: r["_rank"] for r in rows.groupBy("_k").agg(F.max("_rank").alias("_rank")).collect()}
    entries = []
    for b in range(rows.agg(F.max("_b")).first()[0], -1, -1):
        entries += [(k, b, r) for k, r in sought.items() if r]
        asked = F.broadcast(spark.createDataFrame(list(sought.items()), "_k long, _rank long"))
        for r in leaving.where(F.col("_b") == b).join(asked, ["_k", "_rank"]).select("_k", "_left").collect():
            sought[r["_k"]] = r["_left"]
    entered = spark.createDataFrame(entries, "_k long, _b int, _sought long")
    out = stored(rows.join(entered, ["_k", "_b"]).groupBy("_k", "_b").applyInPandas(_marked, "_x long"), "marked")
    dropped(rows, leaving)
    return out


def _longest(df: DataFrame, keys: list[str], usable: Column, order: list[Column], height: list, block: int, in_order: list[str], small, across: str | None = None) -> DataFrame:
    """small: folds the rows of one key, by `in_order`. height: columns to order by, given the place. across: of a
    chain, its first coordinate."""
    df_in = df.where(usable)
    sizes = df_in.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block)
    large = stored(sizes.withColumn("_k", F.monotonically_increasing_id()), "large")
    n, rows = large.agg(F.count("*"), F.sum("_rows")).first()
    fold = lambda part: by_rows(part, keys, in_order, small, df.columns)
    if not n:
        return fold(df_in)
    few = F.broadcast(large) if n <= SPREAD else large
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    rest = df_in.alias("s").join(few.alias("l"), same, "left_anti")
    mine = df_in.alias("s").join(few.alias("l"), same).select("s.*", "l._k")
    parts = -(-rows // block)
    line = [F.col("_k"), *order, F.col("_tie")]
    dealt = mine.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *line).sortWithinPartitions(*line).drop("_tie")
    placed = stored(dealt.withColumn("_x", F.monotonically_increasing_id()).withColumn("_i", F.spark_partition_id()), "placed")
    up = ["_k", *height]
    points = stored(placed.repartitionByRange(parts, *up).sortWithinPartitions(*up).select("_k", "_x", "_i", F.monotonically_increasing_id().alias("_y"), F.spark_partition_id().alias("_j")), "points")
    ranks, used = _ranked(points)
    if across:  # of points of one first coordinate and one rank, the lowest is the first
        first = ranks.join(placed.select("_x", F.col(across).alias("_c")), "_x").groupBy("_k", "_c", "_rank").agg(F.min_by(F.struct("_x", "_y", "_bj"), "_y").alias("p"))
        ranks = first.select("_k", "_rank", "p.*")
    marked = _read_back(ranks, "_bj" if across else "_bi", "_y" if across else "_x")
    dropped(points, *used)
    return fold(rest).unionByName(placed.join(marked, "_x").select(*df.columns))


def longest_run(df: DataFrame, keys: list[str], order: list[str], value: str, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """The rows of each key that lie on its longest run of values that never fall (strict: always rise)
    in `order`. Rows whose value is null or NaN are passed over. Of several longest runs, the one that
    is read backwards from the last row of the greatest rank. Rows that agree in `order` are taken by
    ascending value."""

    at = df.columns.index(value)

    def small(rows: list[tuple]) -> list[tuple]:
        return [rows[k] for k in increasing([r[at] for r in rows], strict)]

    usable = F.col(value).isNotNull() & ~F.coalesce(F.isnan(F.col(value).cast("double")), F.lit(False))
    place = F.col("_x").desc() if strict else F.col("_x").asc()
    return _longest(df, keys, usable, [*map(F.col, order), F.col(value)], [F.col(value).asc(), place], block, [*order, value], small)


def longest_chain(df: DataFrame, keys: list[str], x: str, y: str, block: int = BLOCK) -> DataFrame:
    """The rows of each key on its longest chain of points that rise in both coordinates; of several, in
    order of (x, y), the one whose last point is the first of the greatest rank, and so on backwards.
    Points with a null or NaN are passed over; of equal points one counts."""

    a, b = df.columns.index(x), df.columns.index(y)

    def small(rows: list[tuple]) -> list[tuple]:
        return [rows[k] for k in chain([(r[a], r[b]) for r in rows])]

    usable = F.lit(True)
    for c in (x, y):
        usable = usable & F.col(c).isNotNull() & ~F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
    return _longest(df, keys, usable, [F.col(x).asc(), F.col(y).desc()], [F.col(y).asc(), F.col("_x").desc()], block, [x, y], small, x)


def resolve_times(df: DataFrame, keys: list[str], at: str, time: str, pattern: str, hour: str, width: float, to: str = "resolved", block: int = BLOCK) -> DataFrame:
    """Adds the time of each row of a stream in order of the number `at` (no two rows of a key share
    one): `time` where it lies on a longest run that never falls, else what `pattern` may stand for
    between the trusted rows around it, else no less than the row before and `hour`. Nothing looks past
    a trusted row, so the stream is cut there, and a task folds the rows from one to the next. `width`
    is the span of `at` in which rows are searched together."""
    base = stored(df, "readings")
    kept = longest_run(base.select(*keys, at, F.col(time).alias("_time")), keys, [at], "_time", block=block)
    trusted = stored(kept.select(*keys, at, "_time"), "trusted")
    cell = F.floor(F.col(at) / width)
    # A run never falls, so the first of the trusted rows of a bucket has the least time. What lies before it
    # goes on from the last trusted row of an earlier bucket, and is folded with that one's rows.
    marks = trusted.groupBy(*keys, cell.alias("_b")).agg(F.min(at).alias("_first"), F.min("_time").alias("_least"), F.lit(True).alias("_any"))
    seen = base.select(*keys, cell.alias("_b")).distinct().unionByName(marks, allowMissingColumns=True)
    line = Window.partitionBy(*keys).orderBy("_b")
    buckets = seen.groupBy(*keys, "_b").agg(F.min("_first").alias("_first"), F.min("_least").alias("_least"), F.max("_any").alias("_any"))
    buckets = buckets.withColumn("_old", F.last(F.when(F.col("_any"), F.col("_b")), True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    down = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_new", F.last("_least", True).over(down)).drop("_any")
    rows = base.withColumn("_mark", F.lit(1)).unionByName(trusted.select(*keys, at, F.lit(0).alias("_mark")), allowMissingColumns=True)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = rows.withColumn("_b", cell).alias("r").join(buckets.alias("b"), [*same, F.col("r._b") == F.col("b._b")])
    own = F.col(at) >= F.col("b._first")
    part, following = F.when(own, F.col("r._b")).otherwise(F.col("b._old")), F.when(own, F.col("b._new")).otherwise(F.coalesce("b._least", "b._new"))
    placed = placed.select("r.*", part.alias("_part"), following.alias("_next")).drop("_b")
    spots = [placed.columns.index(c) for c in (time, pattern, hour)]
    mark, wide = placed.columns.index("_mark"), len(df.columns)
    whole = lambda x: None if x is None or x != x else int(x)

    def fold(group: list[tuple]) -> list[tuple]:
        own, first = [], set()
        for r in group:  # the mark of a trusted row comes before the row
            if r[mark]:
                own.append(r)
            else:
                first.add(len(own))
        times, texts, hours = ([r[k] for r in own] for k in spots)
        following = group[-1][-1]
        out = resolved([*map(whole, times)], texts, [*map(whole, hours)], first, float("inf") if following is None else following)
        return [(*r[:wide], t) for r, t in zip(own, out)]

    # Each bucket starts afresh at its first trusted row.
    return by_rows(placed, [*keys, "_part"], [at, "_mark"], fold, [*df.columns, to], {to: "bigint"})
