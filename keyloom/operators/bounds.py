"""Bounds of key ranges as predicates that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.codec import as_bytes, successor


@dataclass(frozen=True)
class Bound:
    """None: unbounded."""

    key: bytes | None = None
    included: bool = True


UNBOUNDED = Bound()


def included(key) -> Bound:
    return Bound(as_bytes(key))


def excluded(key) -> Bound:
    return Bound(as_bytes(key), False)


def _bound(x, included_by_default: bool) -> Bound:
    if isinstance(x, Bound):
        return x
    return UNBOUNDED if x is None else Bound(as_bytes(x), included_by_default)


def in_range(key: Column, start=None, end=None) -> Column:
    """start <= key < end by default; Bound objects say otherwise. Inverted bounds hold nothing."""
    start, end = _bound(start, True), _bound(end, False)
    out = F.lit(True)
    if start.key is not None:
        out = out & ((key >= F.lit(start.key)) if start.included else (key > F.lit(start.key)))
    if end.key is not None:
        out = out & ((key <= F.lit(end.key)) if end.included else (key < F.lit(end.key)))
    return out


def has_prefix(key: Column, prefix) -> Column:
    """starts-with as a range: a range is pushed to Parquet, starts-with on binary is not."""
    prefix = as_bytes(prefix)
    return in_range(key, prefix, successor(prefix))
