"""Sharding by Hilbert-curve ordering: several metadata dimensions are quantised, rows are sorted by
their index on the Hilbert curve of that grid, and the order is cut into runs whose row counts
differ by one at most. Rows close in all dimensions land in one shard, so the ranges of each
dimension that a shard keeps let readers skip whole files. Numbers and strings are quantised alike,
by their exact rank in the table, so cells follow the order in which ranges are compared.

The order is global without any single-task sort: rows are counted by curve cell and, within a
cell, by the first digits of the MD5 of what orders them, more digits for more rows; a row's rank is
the sum of the counts before its bucket and its place in the bucket. So no cell, however common,
meets in one task, nor do rows of one id or of none; only rows that are equal in id, size and
checksum do. Results are the same however rows were dealt over tasks.

Null dimensions take the lowest grid value; a null text has no bytes (size 1, crc 0). Rows with
null or repeated ids, and equal rows, each get a place of their own; rows equal in all that orders
them are interchangeable. Groups of equal texts are not kept together: the law is `rows`, so a group
may lie on several shards. Other columns are not looked at; columns named curve, shard or slot are
replaced. An empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import free_name, prefix_sums, stash

#: Bits for each dimension, and rows for a task to order.
BITS, BUCKET_ROWS = 4, 50_000
#: Up to 2 to the power of this many curve cells are broadcast, a number and a sum each.
BROADCAST_BITS = 16


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates below 2 ** bits (Skilling's
    transform, all rows at once)."""
    x = axes.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, 0)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def cuts(df: DataFrame, column: str, bits: int = BITS) -> list[tuple[int, object]]:
    """(cell, least value) of each grid cell of a column: a value's cell is the share of the rows whose
    value is smaller, times 2 ** bits, rounded down. Exact, over all rows: values are counted, sorted by
    ranges, and summed up in two levels."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    values = stash(values.repartitionByRange("v").withColumn("bucket", F.spark_partition_id()), "values")
    total = values.agg(F.sum("n")).head()[0]
    if not total:
        return []
    values = prefix_sums(values, [], "bucket", [F.col("v")], F.col("n"), "before")
    cell = F.expr(f"before * {1 << bits} div {total}").alias("cell")
    return sorted((r["cell"], r["least"]) for r in values.groupBy(cell).agg(F.min("v").alias("least")).collect())  # at most 2 ** bits rows


def quantised(df: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """Grid coordinates of each column; nulls have 0."""
    out = []
    for c in columns:
        steps = [F.when(F.col(c) >= F.lit(least), cell).otherwise(0) for cell, least in cuts(df, c, bits)]
        out.append(F.coalesce(F.greatest(F.lit(0), F.lit(0), *steps), F.lit(0)).cast("int"))
    return out


def hilbert_shards(df: DataFrame, columns: list[str], ties: list[Column], shards: int, bits: int = BITS) -> DataFrame:
    """df with curve (place on the curve), shard and slot (both long, slots gapless from 0). Rows of one
    curve cell are in the order of the MD5 of their ties, then of the ties."""
    names = [free_name(df, f"_axis{i}") for i in range(len(columns))]
    key, bucket, inner, before = (free_name(df, c) for c in ("_key", "_bucket", "_inner", "_before"))

    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a.to_numpy() for a in axes], 1), bits))

    index.__annotations__ = {"axes": pd.Series, "return": pd.Series}
    curve = F.pandas_udf(index, "long")
    md5 = F.md5(F.concat_ws(":", *[F.coalesce(t.cast("string"), F.lit("null")) for t in ties]))
    rows = df.select(*[F.col(c) for c in df.columns if c not in ("curve", "shard", "slot")], *[a.alias(n) for a, n in zip(quantised(df, columns, bits), names)])
    rows = stash(rows.withColumn("curve", curve(*names)).drop(*names).withColumn(key, md5), "curve")
    total = rows.count()
    if not total:
        return rows.drop(key).withColumns({"shard": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})
    digits = max(1, math.ceil(math.log(max(1, total / BUCKET_ROWS), 16)))
    rows = rows.withColumn(bucket, F.substring(key, 1, digits))
    rows = prefix_sums(rows, ["curve"], bucket, [F.col(key), *ties], F.lit(1), inner)
    cells = rows.groupBy("curve").count().withColumn("_all", F.lit(1))  # at most 2 ** (bits * columns) rows
    cells = prefix_sums(cells.withColumnRenamed("curve", "_cell"), ["_all"], "_cell", [F.lit(1)], F.col("count"), before)
    cells = cells.select(F.col("_cell").alias("curve"), before)
    rows = rows.join(F.broadcast(cells) if bits * len(columns) <= BROADCAST_BITS else cells, "curve")
    rank = F.col(before) + F.col(inner)
    shard = F.expr(f"(`{before}` + `{inner}`) * {shards} div {total}")
    rows = rows.withColumn("shard", shard)
    start = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    order = [*[c for c in df.columns if c not in ("curve", "shard", "slot")], "curve", "shard"]
    return rows.withColumn("slot", rank - start).select(*order, "slot")


def shard_documents(docs: DataFrame, columns: list[str], shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, the columns, curve, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), *[c for c in columns if c not in ("doc_id", "size", "text_crc32")],
    )
    ties = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    return hilbert_shards(rows, columns, ties, shards)


def file_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """For each shard the smallest and largest value of each column: what readers skip files by."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]
    )
