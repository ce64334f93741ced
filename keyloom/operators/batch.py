"""Shaping of write batches: last write of a page, contiguous runs, equal parts, entry sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.layout import is_overflow, serialized_size


#: Bits of a digit of ids: a window over distinct ids that agree in the digits above has at most 2 ** DIGIT rows.
DIGIT = 16


def ranked(rows: DataFrame, order: str, digit: int = DIGIT) -> DataFrame:
    """Adds _rank, from 0, in the order of an integer column without repeats or nulls. Ids are ranked
    digit by digit: counts of ids that agree in the upper digits are summed up among those that agree
    in all but the last of them, so however ids lie no window has more than 2 ** digit rows (the
    top one: the ids' span by 2 ** (3 * digit))."""
    names = [f"_d{level}" for level in range(1, 4)]
    rows = rows.withColumns({n: F.shiftright(F.col(order).cast("long"), digit * (i + 1)) for i, n in enumerate(names)})
    counts, tables = rows.groupBy(*names).count(), []
    for i, name in enumerate(names):
        above = names[i + 1 : i + 2] or [F.lit(0)]
        before = Window.partitionBy(*above).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        tables.append(counts.select(*names[i:], F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"_n{i}")))
        counts = counts.groupBy(*names[i + 1 :]).agg(F.sum("count").alias("count"))
    start = tables[0]
    for i, table in enumerate(tables[1:], 1):
        start = start.join(table, names[i:])
    start = start.select(names[0], (F.col("_n0") + F.col("_n1") + F.col("_n2")).alias("_start"))
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(names[0]).orderBy(order)) - 1
    return rows.join(start, names[0]).withColumn("_rank", rank).drop(*names, "_start")


def coalesce_pages(writes: DataFrame, page: str = "page_id", seq: str = "seq", data: str = "data") -> DataFrame:
    """The last write of each page."""
    return writes.groupBy(page).agg(F.max_by(data, seq).alias(data))


def sequential_bytes(writes: DataFrame, group: str, seq: str = "seq", data: str = "data") -> DataFrame:
    """The data of each group joined in the order of seq."""
    parts = F.sort_array(F.collect_list(F.struct(seq, data)))
    return writes.groupBy(group).agg(F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x[data])).alias(data))


def flush_points(writes: DataFrame, group: str, order: str, size: Column, most: int = 16 << 20) -> DataFrame:
    """Adds flush: the number of whole buffers of `most` bytes that are full before each write."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("flush", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / most))


def contiguous_ranges(pages: DataFrame, page: str = "page_id", block: int = 1 << DIGIT) -> DataFrame:
    """start, pages, end of each run of consecutive ids. Runs are found within blocks of ids, in
    parallel; runs that touch a block's edge are joined within blocks of blocks, and what touches
    their edges (at most two rows for block * block ids) in one last pass."""
    of = lambda column, size: F.expr(f"({column} - pmod({column}, {size}L)) div {size}L")
    ids = pages.select(F.col(page).cast("long").alias("p")).distinct().withColumn("b", of("p", block))
    w = Window.partitionBy("b").orderBy("p")
    runs = ids.withColumn("g", F.col("p") - F.row_number().over(w)).groupBy("b", "g").agg(F.min("p").alias("s"), F.max("p").alias("e"))
    done, runs = [], runs.select("s", "e")
    for size, wider in ((block, block * block), (block * block, None)):
        at_edge = F.expr(f"pmod(s, {size}L) = 0 or pmod(e, {size}L) = {size - 1}L")
        done.append(runs.where(~at_edge))
        group = of("s", wider) if wider else F.lit(0)
        edge = Window.partitionBy("g").orderBy("s")
        runs = runs.where(at_edge).withColumn("g", group).withColumn("new", F.when(F.col("s") == F.lag("e").over(edge) + 1, 0).otherwise(1))
        runs = runs.withColumn("n", F.sum("new").over(edge)).groupBy("g", "n").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("s", "e")
    for part in done:
        runs = runs.unionByName(part)
    return runs.select(F.col("s").alias("start"), (F.col("e") - F.col("s") + 1).alias("pages"), F.col("e").alias("end"))


def total_size(pages: DataFrame, data: str = "data") -> DataFrame:
    """pages and bytes of a batch."""
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).cast("long").alias("bytes"))


def chunk(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk: runs of `size` rows in the order of an integer column without repeats."""
    return group_commits(rows, order, size).withColumnRenamed("batch", "chunk")


def range_offset(start: Column, page_size: int) -> Column:
    return start * page_size


def partition_runs(pages: DataFrame, parts: int, page: str = "page_id") -> DataFrame:
    """Adds part: runs of ceil(n / parts) pages in the order of their ids, which don't repeat; one part
    if there are under 2 * parts pages."""
    n = pages.count()
    if parts <= 1 or n < 2 * parts:
        return pages.withColumn("part", F.lit(0).cast("long"))
    return ranked(pages, page).withColumn("part", F.floor(F.col("_rank") / math.ceil(n / parts)).cast("long")).drop("_rank")


def partition_stats(parts: DataFrame, part: str = "part") -> DataFrame:
    """partitions, total, smallest, largest and imbalance (largest / smallest; 1 of nothing)."""
    sizes = parts.groupBy(part).agg(F.count("*").alias("n"))
    out = sizes.agg(
        F.count("*").alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )
    ratio = F.when(F.col("smallest") > 0, F.col("largest") / F.col("smallest")).when(F.col("largest") == 0, 1.0).otherwise(float("inf"))
    return out.withColumn("imbalance", ratio.cast("double"))


def prepare_entries(kv: DataFrame, threshold: int = 16 * 1024) -> DataFrame:
    """Adds is_overflow, serialized_size and crc of each entry."""
    key, value = F.col("key"), F.col("value")
    return kv.withColumns(
        {"is_overflow": is_overflow(value, threshold), "serialized_size": serialized_size(key, value, threshold), "crc": F.crc32(value)}
    )


def entry_stats(kv: DataFrame, threshold: int = 16 * 1024) -> DataFrame:
    """entries, overflow_entries, total_bytes."""
    return prepare_entries(kv, threshold).agg(
        F.count("*").alias("entries"), F.count_if("is_overflow").alias("overflow_entries"),
        F.coalesce(F.sum("serialized_size"), F.lit(0)).alias("total_bytes"),
    )


def group_commits(commits: DataFrame, order: str = "lsn", most: int = 100) -> DataFrame:
    """Adds batch: groups of `most` commits in the order of an integer column without repeats."""
    return ranked(commits, order).withColumn("batch", F.floor(F.col("_rank") / most).cast("long")).drop("_rank")
