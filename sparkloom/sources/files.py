"""Files: whole-document JSON, tab-separated words, word lists, and sinks for reports and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A JSON document that is one object, as rows of key and value; `value` is the values' type."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return text.select(F.explode("m").alias(key, "value"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is an array of objects (absent fields are null), with its file name."""
    return spark.read.json(path, schema=schema, multiLine=True).withColumn("file", F.input_file_name())


def timed_words(spark: SparkSession, path: str) -> DataFrame:
    """[[start, end, word], ...] of each file as rows: tape, seq, start, end, word, token."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("tape"), F.from_json("value", "array<array<string>>").alias("w"))
    rows = text.select("tape", F.posexplode("w").alias("seq", "w"))
    return rows.select("tape", "seq", F.col("w")[0].cast("double").alias("start"), F.col("w")[1].cast("double").alias("end"), F.col("w")[2].alias("word"), F.regexp_replace(F.lower(F.col("w")[2]), "[^a-z0-9]", "").alias("token"))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's tab-separated output: blank ones and other levels go, and y is the
    median of the line."""
    t = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    w = t.where((F.col("level") == 5) & (F.trim("text") != "")).select(*(F.col(c).cast("int").alias(c) for c in ("page_num", "block_num", "par_num", "line_num", "word_num")), F.col("left").cast("double").alias("x"), F.col("top").cast("double").alias("y"), F.col("conf").cast("double").alias("conf"), "text")
    line = ["page_num", "block_num", "par_num", "line_num"]
    return w.join(w.groupBy(*line).agg(F.median("y").alias("line_y")), line).drop("y").withColumnRenamed("line_y", "y")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word a line; blank lines and those that start with # are no words."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def write_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrites those partitions of `by` that df has rows of, and no others."""
    spark = df.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(by).parquet(path)
    finally:
        spark.conf.set(mode, was)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def with_cache(keys: DataFrame, cache: DataFrame, compute, on: list[str]) -> DataFrame:
    """A memo: rows of the cache for the keys that it has, and compute(missing keys) for the others."""
    return cache.join(keys.select(*on).distinct(), on, "left_semi").unionByName(compute(keys.join(cache.select(*on).distinct(), on, "left_anti")))
