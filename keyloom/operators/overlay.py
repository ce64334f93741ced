"""Last-write-wins: operations collapsed to one a key, and laid over a base.

Operations have columns txid, seq, op ('put' or 'del'), ns, key, value; (txid, seq) orders them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.codec import successor

KEYS = ["ns", "key"]


def collapse(ops: DataFrame, keys: list[str] = KEYS, order: tuple[str, ...] = ("txid", "seq"), keep: tuple[str, ...] = ("op", "value")) -> DataFrame:
    """The last operation of each key. A partial aggregate, so a key written millions of times costs
    one row a task."""
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("_last")
    return ops.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in keep])


def apply_ops(base: DataFrame, last: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """base without the keys of last, and the puts of last. last: at most one row a key. Spark
    broadcasts last if it is small and shuffles both otherwise."""
    kept = base.join(last.select(*keys), keys, "left_anti").select(*keys, value)
    return kept.unionByName(last.where(F.col("op") == "put").select(*keys, value))


def inside(column: Column, ns: bytes) -> Column:
    """Whether a namespace is ns or below it, as a range."""
    end = successor(ns)
    return (column >= F.lit(ns)) & ((column < F.lit(end)) if end is not None else F.lit(True))


def without_below(rows: DataFrame, ns: bytes) -> DataFrame:
    """Rows outside a namespace and all below it (a cascade), as one pushed range predicate."""
    return rows.where(~inside(F.col("ns"), ns))


def updates(base: DataFrame, puts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Puts of keys that base has."""
    return puts.join(base.select(*keys), keys, "left_semi")


def inserts(base: DataFrame, puts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Puts of keys that base lacks."""
    return puts.join(base.select(*keys), keys, "left_anti")
