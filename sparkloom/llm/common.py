"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would also change other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def tidy() -> None:
    """Gives freed memory back. Workers serve one task after the other, and what one kept in its
    allocators would add to what the next one needs."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local master (tests) gets a
    folder of its own; a cluster is refused, as its executors could not see a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return _own[sc.applicationId]


#: Has Spark delete the shuffle files of a query as it ends. Otherwise they stay until the driver's garbage
#: collector finds that nothing refers to them, which on a driver with much memory is after the last step.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession):
    """Shuffle files of what is run in it go as it ends. For writes, whose plans nothing else reads."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before) if before is not None else spark.conf.unset(RELEASE)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again, so that a lost
    executor costs a re-read rather than a recomputation. Shuffle files of the write are deleted."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes stored tables. Only what nothing unfinished reads may be dropped: call it once all that
    is derived from them is stored itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, size: int, a_task: int, *columns: str | Column) -> DataFrame:
    """df dealt out by columns: to the session's number of tasks, or to more where these would take
    over `a_task` of `size` each."""
    parts = -(-size // a_task)
    few = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*columns) if few else df.repartition(parts, *columns)


#: Words of 64 bits in a table of marks (`marks`): it has no more rows, whatever the input.
MARKS = 1 << 18


def _mark(key: Column) -> tuple[Column, Column]:
    """The word of the table that a key falls into, and its bit."""
    h = F.xxhash64(key)
    return F.pmod(F.shiftright(h, 6), F.lit(MARKS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def marks(keys: DataFrame, key: str) -> DataFrame:
    """A table of bounded size that says of each key whether it may be among `keys`."""
    word, bit = _mark(F.col(key))
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(df: DataFrame, key: str, table: DataFrame, to: str) -> DataFrame:
    """Adds `to`: false if the key is not among those of the table; true of all others and of a few more, of most
    where the keys are many times the table's bits. Rows stay where they are."""
    name, bits = fresh(df, "_word"), fresh(df, "_bits")
    word, bit = _mark(F.col(key))
    met = df.withColumn(name, word).join(F.broadcast(table.select(F.col("word").alias(name), F.col("bits").alias(bits))), name, "left")
    return met.withColumn(to, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).select(*df.columns, to)


def least_reaching(df: DataFrame, column: str, most: int) -> int:
    """The least value of a column of counts that at most `most` rows reach, from a small histogram.
    A sort with a limit would send that many rows of each partition to the driver."""
    c = F.col(column)
    bins = df.groupBy(F.floor(F.log2(c) * 64).alias("bin")).agg(F.count("*").alias("rows"), F.min(c).alias("least"), F.max(c).alias("most")).orderBy(F.desc("bin")).collect()
    total, least = 0, 1 + max((b["most"] for b in bins), default=0)
    for b in bins:
        total += b["rows"]
        if total > most:
            break
        least = b["least"]
    return least


SLICES, SLICED = 16, "slice int, salt int, sums binary"


def sliced(total: np.ndarray) -> pa.RecordBatch:
    """A task's table of whole numbers, as rows to be added up by `sliced_sum`."""
    parts = np.array_split(total.ravel().astype(np.int64), SLICES)
    salt = TaskContext.get().partitionId() % 8 if TaskContext.get() else 0
    return pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "salt", "sums"])


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("slice").to_pylist(), b.column("sums").to_pylist()):
            x = np.frombuffer(raw, np.int64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "salt", "sums"])


def sliced_sum(tables: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' tables, all of one size, by slices and in two levels. Whole numbers have
    one sum in any order, so it does not depend on how rows are split over tasks."""
    got = tables.repartition("slice", "salt").mapInArrow(_added, SLICED).repartition("slice").mapInArrow(_added, SLICED).collect()
    return np.concatenate([np.frombuffer(r["sums"], np.int64) for r in sorted(got, key=lambda r: r["slice"])]) if got else np.zeros(size, np.int64)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
