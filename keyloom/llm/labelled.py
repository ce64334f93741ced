"""Bounded samples of labelled and unlabelled rows for training; folds by crc32 of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import stash


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, values=(0, 1)) -> DataFrame:
    """At most `rows` labelled training rows of each label value: (text, y). Labels of the held-out
    remainder are never read, null ones are no labels. The choice is by hash of the id, so it does
    not depend on partitions. Ids are chosen first; documents are then read once for them."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where(
        (remainder(F.col("_id"), modulus) != held_out) & F.col("y").isin(*values)
    )
    parts = [
        usable.where(F.col("y") == v).join(docs.select(F.col("doc_id").cast("long").alias("_id")), "_id", "left_semi")
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(rows)
        for v in values
    ]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = stash(chosen, "chosen")  # at most rows * len(values) ids: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("text", "y")


def unlabelled(docs: DataFrame, rows: int) -> DataFrame:
    """At most `rows` texts, by hash of the id, whatever their labels: (text)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    chosen = stash(ids.orderBy(F.xxhash64("_id", F.lit(29)), "_id").limit(rows), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id", "left_semi").select("text")
