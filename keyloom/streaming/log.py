"""Logs of transactions: recovery of what was committed, and following a growing log.

A log has columns lsn, rtype (put, delete, begin, commit, abort, checkpoint), txid (of begin,
commit, abort), key, value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.overlay import collapse

LOG = "lsn long, rtype string, txid long, key binary, value binary"


def attribute(log: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Adds owner, the open transaction of each put and delete, and incarnation, the lsn of its begin;
    operations before any begin or after their transaction's end have none. The last boundary is
    carried forward within blocks of lsn in parallel, over the last boundaries of the blocks of a
    larger block, again in parallel, and over those of the larger blocks (block * block of lsn each)."""
    edge = F.when(F.col("rtype").isin("begin", "commit", "abort"), F.struct("rtype", "txid", "lsn"))
    rows = log.withColumn("_b", F.floor(F.col("lsn") / block)).withColumn("_edge", edge)
    latest = F.max_by("_edge", F.col("_edge.lsn")).alias("_edge")  # null where there is no boundary
    blocks = rows.groupBy("_b").agg(latest).withColumn("_w", F.floor(F.col("_b") / block))
    before = lambda group, order: F.last("_edge", True).over(
        Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    wide = blocks.groupBy("_w").agg(latest).select("_w", before(F.lit(0), "_w").alias("_wide"))
    blocks = blocks.withColumn("_near", before("_w", "_b")).join(wide, "_w").select("_b", F.coalesce("_near", "_wide").alias("_before"))
    here = Window.partitionBy("_b").orderBy("lsn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_here", F.last("_edge", True).over(here)).join(blocks, "_b", "left")
    open_ = F.coalesce("_here", "_before")
    mine = F.when(open_["rtype"] == "begin", open_)
    return rows.withColumns({"owner": mine["txid"], "incarnation": mine["lsn"]}).drop("_b", "_edge", "_here", "_before")


def committed(log: DataFrame, since: int = 0) -> DataFrame:
    """Puts and deletes of committed transactions with txid, seq (lsn), commit_lsn, op, key, value. A
    begin of a known txid, or an abort, takes back what that transaction did before."""
    log = log.where(F.col("lsn") >= since)
    ends = log.where("rtype in ('begin', 'commit', 'abort')").groupBy("txid").agg(
        F.max(F.when(F.col("rtype") == "commit", F.col("lsn"))).alias("commit_lsn"),
        F.max(F.when(F.col("rtype") == "begin", F.col("lsn"))).alias("begin_lsn"),
        F.max(F.when(F.col("rtype") == "abort", F.col("lsn"))).alias("abort_lsn"),
    )
    ends = ends.where("commit_lsn > begin_lsn and (abort_lsn is null or abort_lsn < begin_lsn)")
    ops = attribute(log).where("rtype in ('put', 'delete') and owner is not null")
    ops = ops.select("lsn", "rtype", F.col("owner").alias("txid"), "incarnation", "key", "value")
    good = ops.join(ends.select("txid", "begin_lsn", "commit_lsn"), "txid").where("incarnation = begin_lsn and lsn < commit_lsn")
    return good.select("txid", F.col("lsn").alias("seq"), "commit_lsn", F.expr("if(rtype = 'put', 'put', 'del')").alias("op"), "key", "value")


def recover(log: DataFrame, since: int = 0) -> DataFrame:
    """The last committed operation of each key, transactions in the order of their commits."""
    return collapse(committed(log, since), ["key"], ("commit_lsn", "seq"))


def follow(spark, path: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, files: int = 1000):
    """Streams new committed deltas (Parquet with txid, seq, op, ns, key, value) to apply(batch, id),
    each batch collapsed to the last operation of a key, with its txid and seq: batches hold files in
    any order, so what apply merges them into must keep the greatest. once: stops after what is there
    now."""
    schema = "txid long, seq long, op string, ns binary, key binary, value binary"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)

    def each(batch: DataFrame, id: int) -> None:
        apply(collapse(batch, keep=("txid", "seq", "op", "value")), id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def unique_operations(stream: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Drops repeated deliveries of (txid, seq) that come within the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["txid", "seq"])
