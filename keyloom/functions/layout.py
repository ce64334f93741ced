"""Sizes, pages and log positions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_SIZES = (4096, 8192, 16384, 32768, 65536)
PAGE_HEADER, DIRECT_HEADER, REFERENCE = 24, 12, 16


def is_page_size(n: Column) -> Column:
    return n.isin(*PAGE_SIZES)


def is_overflow(value: Column, threshold: int = 16 * 1024) -> Column:
    return F.octet_length(value) > threshold


def direct_size(length: Column) -> Column:
    """Bytes of a value in the direct format; 0 for none."""
    return F.when(length == 0, 0).otherwise(length + DIRECT_HEADER).cast("long")


def chain_size(length: Column, page: int = 32768) -> Column:
    """Bytes of a value in whole pages."""
    return (F.ceil(length / F.lit(page - PAGE_HEADER)) * page).cast("long")


def serialized_size(key: Column, value: Column, threshold: int = 16 * 1024) -> Column:
    rest = F.when(is_overflow(value, threshold), REFERENCE).otherwise(F.octet_length(value) + 4)
    return (F.octet_length(key) + 4 + rest).cast("long")


def lsn(segment: Column, offset: Column) -> Column:
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(offset.cast("long"))


def lsn_segment(x: Column) -> Column:
    return F.shiftright(x, 32)


def lsn_offset(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
