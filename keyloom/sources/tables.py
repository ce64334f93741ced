"""Tables as key-value relations: any source that Spark reads becomes entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.codec import encode_path


def as_entries(df: DataFrame, key: Column, value: Column, path: tuple = ()) -> DataFrame:
    """(ns, key, value) of a table under one path."""
    return df.select(F.lit(encode_path(path)).alias("ns"), key.cast("string").cast("binary").alias("key"), value.cast("string").cast("binary").alias("value"))


def csv_entries(spark, path: str, key: str, value: str, **options) -> DataFrame:
    return as_entries(spark.read.options(header=True, **options).csv(path), F.col(key), F.col(value))


def json_entries(spark, path: str, key: str, value: str, **options) -> DataFrame:
    return as_entries(spark.read.options(**options).json(path), F.col(key), F.col(value))


def parquet_entries(spark, path: str, key: str, value: str) -> DataFrame:
    return as_entries(spark.read.parquet(path), F.col(key), F.col(value))


def export_entries(kv: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Writes entries in key order, range-partitioned; binary columns as hex for text formats."""
    rows = kv.repartitionByRange("ns", "key").sortWithinPartitions("ns", "key")
    if format in ("csv", "json", "text"):
        rows = rows.select(*[F.lower(F.hex(c)).alias(c) for c in rows.columns])
    rows.write.format(format).mode(mode).save(path)
