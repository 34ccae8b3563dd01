"""Upserts and other keyed writes as DataFrame -> DataFrame: the new state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_write_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert or ignore: of the rows of a key, the first in `order`. Aggregates before the shuffle."""
    return _one(rows, keys, F.min_by, order)


def last_write_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert or replace: of the rows of a key, the last in `order`."""
    return _one(rows, keys, F.max_by, order)


def _one(rows, keys, pick, order):
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert_add(state: DataFrame, changes: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Counters: adds the changes to what is there."""
    return state.select(*keys, n).unionByName(changes.select(*keys, n)).groupBy(*keys).agg(F.sum(n).alias(n))


def insert_missing(state: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Appends the rows whose key the state lacks; of several, the first in `order` (if none is given,
    by all other columns)."""
    new = rows.join(state.select(*keys).distinct(), keys, "left_anti")
    rest = [F.col(c) for c in rows.columns if c not in keys]
    return state.unionByName(first_write_wins(new, keys, *(order or rest)) if rest else new.distinct())


def to_do(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """A restartable batch: the rows whose output is not there yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def sync_lists(here: DataFrame, there: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """key, action: `upload` for what is here, not rejected and not there; `delete` for what is there
    and rejected."""
    bad = rejected.select(key).distinct()
    upload = here.select(key).distinct().join(bad, key, "left_anti").join(there.select(key), key, "left_anti")
    delete = there.select(key).distinct().join(bad, key, "left_semi")
    return upload.withColumn("action", F.lit("upload")).unionByName(delete.withColumn("action", F.lit("delete")))


def whole_units(rows: DataFrame, keys: list[str], amount: Column, unit: float) -> DataFrame:
    """Counters that send whole units and keep the rest: sent, and what is left."""
    total = F.sum(amount)
    return rows.groupBy(*keys).agg(F.floor(total / unit).alias("sent"), (total - unit * F.floor(total / unit)).alias("left"))


def apply_changes(state: DataFrame, changes: DataFrame, key: str, removed: str) -> DataFrame:
    """A change feed: rows flagged by the column `removed` delete their key, the others upsert it."""
    kept = state.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(~F.col(removed)).select(*state.columns))


def set_where(state: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE."""
    return state.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def toggled(events: DataFrame, keys: list[str], on: Column, *order: Column) -> DataFrame:
    """Keys whose last event switches them on."""
    return events.groupBy(*keys).agg(F.max_by(on, F.struct(*order)).alias("_on")).where("_on").select(*keys)


def under_limit(rows: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows of each key. Ranks group by group are cut early by Spark's
    window group limit, so a key's overflow is dropped before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
