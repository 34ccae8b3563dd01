"""Clustering of integer vectors around centroids, by annulus search (Lloyd rounds, exact).

A centroid nearer to x than u has a norm within u of x's norm. Centroids are sorted by norm; x's exact
distance to the one of the nearest norm is its upper bound u, binary search finds the centroids in the
annulus from |x| - u to |x| + u, and these alone are compared exactly, in whole numbers. The annulus is
widened by more than the rounding of its square roots, so a centroid on its border is among them, and
of equally near centroids the smaller number wins.

A round is one scan of the vectors, from which tasks send sums for each cluster (exact whole numbers,
added up in two levels); the driver sees at most 32 rows for each cluster. Nothing is broadcast but the
centroids. Sums do not depend on how rows are split over tasks.

Vectors that are null, have another number of components, or a null or non-finite component are left
out. A component of any size counts exactly; a distance or an inertia beyond a long is null. Repeated
rows count each for itself. Null ids are clustered as others, but start a cluster only where too few
other vectors do. An empty table (or none kept) gives no rows; fewer vectors than clusters give fewer
clusters. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to this size of a component, squared distances of 64 components fit in a long.
SMALL = 1 << 26
SCALE = 1024
SALTS = 32
_LONG = (1 << 63) - 1
_PARTS = "cluster int, salt int, rows long, sums string, inertia string"


def kept(df: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    """The rows whose vector counts, as columns `id` and `vector` (array of double)."""
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where((F.size("vector") == dims) & F.coalesce(finite, F.lit(False)))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), as longs where all are small, else as Python's integers."""
    if not len(x) or np.abs(x).max() <= SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    cells = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(cells, dtype=object).reshape(x.shape)


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def _root(squares: np.ndarray) -> np.ndarray:
    if squares.dtype == object:
        return np.array([float(math.isqrt(int(v))) for v in squares], np.float64)
    return np.sqrt(squares.astype(np.float64))


class Annulus:
    """Centroids sorted by norm."""

    def __init__(self, centroids: list[list[int]]):
        cells = np.array(centroids, dtype=object)
        squares = _square(cells)
        order = sorted(range(len(centroids)), key=lambda j: (squares[j], j))
        self.number = np.array(order, np.int64)
        self.norm = _root(squares[order])
        self.small = all(-SMALL <= v <= SMALL for c in centroids for v in c)
        self.at = cells[order].astype(np.int64) if self.small else cells[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of x."""
        at = self.at if x.dtype != object else self.at.astype(object)
        norm = _root(_square(x))
        right = np.minimum(np.searchsorted(self.norm, norm), len(self.norm) - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(np.abs(self.norm[left] - norm) < np.abs(self.norm[right] - norm), left, right)
        best, number = _square(x - at[first]), self.number[first]
        reach = _root(best)
        reach += 2 + 1e-9 * (reach + norm)
        low, high = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        for k in range(len(self.norm)):
            rows = np.flatnonzero((low <= k) & (k < high) & (first != k))
            if len(rows):
                d = _square(x[rows] - at[k])
                nearer = (d < best[rows]) | ((d == best[rows]) & (self.number[k] < number[rows]))
                rows = rows[nearer.astype(bool)]
                best[rows], number[rows] = d[nearer.astype(bool)], self.number[k]
        return number, best


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _assigned(x: np.ndarray, index: Annulus):
    """Row numbers, whole vectors, cluster numbers and distances, the few rows of large components apart."""
    large = (np.abs(x) > SMALL / SCALE).any(axis=1) if index.small else np.ones(len(x), bool)
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(rows):
            v = whole(x[rows])
            v = v if index.small or v.dtype == object else v.astype(object)
            yield rows, v, *index.nearest(v)


def _merged(batches):
    total: dict[int, list] = {}
    for b in batches:
        for j, rows, sums, inertia in zip(*(b.column(c).to_pylist() for c in ("cluster", "rows", "sums", "inertia"))):
            old = total.get(j, (0, None, 0))
            new = json.loads(sums)
            total[j] = (old[0] + rows, new if old[1] is None else [a + c for a, c in zip(old[1], new)], old[2] + int(inertia))
    yield _parts(total, 0)


def _parts(total: dict[int, tuple], salt: int) -> pa.RecordBatch:
    cells = [(j, salt, n, json.dumps(s), str(d)) for j, (n, s, d) in total.items()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    names = ["cluster", "salt", "rows", "sums", "inertia"]
    return pa.record_batch([pa.array([c[k] for c in cells], t) for k, t in enumerate(types)], names)


def _round(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int], int]]:
    """Rows, componentwise sums and summed distances of each cluster that has rows."""
    dims = len(centroids[0])

    def sums(batches):
        index, total = Annulus(centroids), {}
        for b in batches:
            for _, v, number, best in _assigned(_vectors(b.column("vector"), dims), index):
                for j in np.unique(number).tolist():
                    mine = number == j
                    n, s, d = total.get(j, (0, [0] * dims, 0))
                    total[j] = n + int(mine.sum()), [a + int(c) for a, c in zip(s, v[mine].sum(axis=0))], d + sum(map(int, best[mine]))
        yield _parts(total, TaskContext.get().partitionId() % SALTS)

    got: dict[int, tuple] = {}
    for r in vectors.select("vector").mapInArrow(sums, _PARTS).repartition("cluster", "salt").mapInArrow(_merged, _PARTS).collect():
        n, s, d = got.get(r["cluster"], (0, [0] * dims, 0))
        got[r["cluster"]] = n + r["rows"], [a + c for a, c in zip(s, json.loads(r["sums"]))], d + int(r["inertia"])
    return got


def start(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids hash least (SHA-256 of `seed:id`), in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.withColumn("_hash", hashed).orderBy(F.col("_hash").asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return [[int(v) for v in whole(np.array([r["vector"]], np.float64))[0]] for r in rows]


def fit(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, *, id: str = "vec_id", vector: str = "embedding", dims: int = 64) -> tuple[list[list[int]], dict[int, int]]:
    """Centroids after the rounds, and the summed squared distance of each cluster that has vectors."""
    vectors = kept(df, id, vector, dims)
    centroids = start(vectors, k, seed)
    if not centroids:
        return [], {}
    for _ in range(rounds):
        for j, (n, s, _) in _round(vectors, centroids).items():
            centroids[j] = [c // n for c in s]
    return centroids, {j: d for j, (_, _, d) in _round(vectors, centroids).items()}


def assign(df: DataFrame, centroids: list[list[int]], *, id: str = "vec_id", vector: str = "embedding", dims: int = 64) -> DataFrame:
    """The id of each vector that counts, its cluster and its squared distance. No centroids: no rows."""
    vectors = kept(df, id, vector, dims)
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def rows(batches):
        index = Annulus(centroids) if centroids else None
        for b in batches:
            if index is None or not b.num_rows:
                continue
            cluster, distance = np.zeros(b.num_rows, np.int32), [0] * b.num_rows
            for at, _, number, best in _assigned(_vectors(b.column("vector"), dims), index):
                cluster[at] = number
                for row, d in zip(at.tolist(), best.tolist()):
                    distance[row] = d if d <= _LONG else None
            yield pa.record_batch([b.column("id"), pa.array(cluster), pa.array(distance, pa.int64())], [id, "cluster", "distance"])

    return vectors.mapInArrow(rows, schema)
