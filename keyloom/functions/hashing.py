"""Checksums, 64-bit FNV-1a and Bloom filters."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values of the hash
SECOND_SEED = 0x517CC1B727220A95  # fixed seed of the second hash of a pair


def crc(value: Column) -> Column:
    """CRC-32 (IEEE), computed in the JVM."""
    return F.crc32(value)


def crc_matches(value: Column, expected: Column) -> Column:
    return F.crc32(value) == expected


def fnv1a_many(values: list[bytes], seed: int = 0) -> np.ndarray:
    """FNV-1a of each value with the seed mixed into the offset, all values a byte at a time."""
    lengths = np.array([len(v) for v in values], np.int64)
    h = np.full(len(values), (FNV_OFFSET ^ seed) & (2**64 - 1), np.uint64)
    if len(values) and lengths.max():
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        sorted_h, sorted_len = h[order], lengths[order]
        for i in range(int(sorted_len[0])):
            live = int(np.searchsorted(-sorted_len, -i, "left"))
            sorted_h[:live] = (sorted_h[:live] ^ flat[starts[:live] + i]) * np.uint64(FNV_PRIME)
        h[order] = sorted_h
    return h


def fnv1a(value: Column, seed: int = 0) -> Column:
    """FNV-1a as 16 hex digits; Arrow batches, since ANSI integers don't wrap."""

    def run(v: pd.Series) -> pd.Series:
        found = fnv1a_many([b"" if x is None else bytes(x) for x in v], seed)
        return pd.Series([None if x is None else f"{h:016x}" for x, h in zip(v, found)])

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(value)


def bytes_sql(text: str) -> str:
    """DuckDB SQL of the UTF-8 bytes of a string expression, as a list of integers."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


#: DuckDB SQL of the 256 steps of CRC-32 by its polynomial, and of a fold over a list of bytes with
#: that list at hand as `steps`.
CRC_STEPS_SQL = (
    "(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]), "
    f"lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END)) AS steps)"
)


def crc_sql(octets: str) -> str:
    fold = f"list_reduce(list_concat([CAST({2**32 - 1} AS BIGINT)], {octets}), lambda a, y: xor(steps[CAST((xor(a, y) & 255) + 1 AS BIGINT)], a >> 8))"
    return f"CAST(xor({fold}, {2**32 - 1}) AS BIGINT)"


def fnv1a_sql(octets: str) -> str:
    """DuckDB SQL of FNV-1a over a list of bytes, as 16 hex digits."""
    fold = f"list_reduce(list_concat([CAST({FNV_OFFSET} AS HUGEINT)], {octets}), lambda a, y: (xor(a, CAST(y AS HUGEINT)) * {FNV_PRIME}) % {2**64})"
    return f"lower(lpad(to_hex({fold}), 16, '0'))"


class BloomFilter:
    """A Bloom filter over byte strings; without false negatives for what was put in."""

    def __init__(self, expected: int, fpp: float = 0.01):
        bits = math.ceil(-max(expected, 1) * math.log(fpp) / math.log(2) ** 2)
        self.bits = -(-max(bits, 64) // 64) * 64
        self.hashes = min(max(math.ceil(self.bits / max(expected, 1) * math.log(2)), 1), 16)
        self.items = 0
        self.words = np.zeros(self.bits // 64, np.uint64)

    def _places(self, keys: list[bytes]) -> np.ndarray:
        a, b = fnv1a_many(keys), fnv1a_many(keys, SECOND_SEED)
        with np.errstate(over="ignore"):
            return (a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.bits)

    def insert(self, *keys: bytes) -> None:
        at = self._places(list(keys)).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.items += len(keys)

    def may_contain(self, *keys: bytes) -> np.ndarray:
        at = self._places(list(keys))
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(1)

    def merge(self, other: "BloomFilter") -> "BloomFilter":
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters of different shapes")
        self.words |= other.words
        self.items += other.items
        return self

    def clear(self) -> None:
        self.words[:] = 0
        self.items = 0

    @property
    def size_bytes(self) -> int:
        return self.bits // 8

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQ", self.bits, self.hashes, self.items) + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "BloomFilter | None":
        if len(data) < 17:
            return None
        bits, hashes, items = struct.unpack_from("<QBQ", data)
        if not bits or bits % 64 or not hashes or len(data) < 17 + bits // 8:
            return None
        out = cls.__new__(cls)
        out.bits, out.hashes, out.items = bits, hashes, items
        out.words = np.frombuffer(data, "<u8", bits // 64, 17).astype(np.uint64)
        return out


def bloom_of(df: DataFrame, key: str, expected: int, fpp: float = 0.01) -> BloomFilter:
    """A filter of a binary column: one partial filter a task, merged in a tree of 16, so the driver
    gets at most 16 filters of the chosen size."""

    def build(batches):
        out = BloomFilter(expected, fpp)
        for b in batches:
            out.insert(*[bytes(x) for x in b["k"] if x is not None])
        yield pd.DataFrame({"part": [int(np.random.default_rng().integers(16))], "filter": [out.to_bytes()]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        out = BloomFilter(expected, fpp)
        for x in group["filter"]:
            out.merge(BloomFilter.from_bytes(bytes(x)))
        return pd.DataFrame({"filter": [out.to_bytes()]})

    parts = df.select(F.col(key).cast("binary").alias("k")).mapInPandas(build, "part int, filter binary")
    total = BloomFilter(expected, fpp)
    for row in parts.groupBy("part").applyInPandas(join, "filter binary").toLocalIterator():
        total.merge(BloomFilter.from_bytes(bytes(row["filter"])))
    return total


def may_contain(filter: BloomFilter, key: Column) -> Column:
    """Whether the filter may hold each key, null for null; the filter goes to the executors once."""

    def run(v: pd.Series) -> pd.Series:
        some = [x is not None for x in v]
        hits = iter(filter.may_contain(*[bytes(x) for x in v if x is not None]) if any(some) else ())
        return pd.Series([bool(next(hits)) if s else None for s in some], dtype=object)

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(key.cast("binary"))
