"""Queries against their SQL where the tables at hand do not reach: accents, many hours, equal times."""

import collections
import datetime

import duckdb

from sparkloom.plans import catalog


def same(spark, path, name: str, table: str) -> None:
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    want = c.sql(catalog.ORACLE_SQL[name])
    have = catalog.QUERIES[name](spark, str(path)).select(*want.columns)
    assert collections.Counter(map(tuple, have.collect())) == collections.Counter(want.fetchall())


def test_text_kinds_with_accents(spark, tmp_path):
    texts = ["Ein ñwal im Süden.", "Ein wal.", "Les élans", "el éle", "a_le"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, tmp_path, "text_kinds", "documents")


def test_glossary_terms_with_accents(spark, tmp_path):
    texts = ["élo and", "lo ñi", "thé the", "ilo", "i_ i"]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    same(spark, tmp_path, "glossary_terms", "conversations")


def events(spark, tmp_path, rows) -> None:
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")


def test_clock_columns_over_many_hours(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    events(spark, tmp_path, [(k, day, 1, "view", 1.0) for k in (0, 37_064, 37_065, 37_165, 400_000)])
    same(spark, tmp_path, "clock_columns", "events")


def test_page_rows_at_equal_times(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    kinds = ["view", "signup", "view", "view", "signup", "view"]
    rows = [(10 * h + k, day + datetime.timedelta(hours=h), 1, kind, 1.0) for h in range(30) for k, kind in enumerate(kinds)]
    events(spark, tmp_path, rows)
    same(spark, tmp_path, "page_rows", "events")
