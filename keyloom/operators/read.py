"""Reads of a key-value relation (ns, key, value) with unique (ns, key).

Every method returns a lazy DataFrame, or a value for single entries. Equality and ranges of ns and
key reach the Parquet scan; key-only reads never touch values. Ordered results are ordered by
unsigned bytes; use toLocalIterator() to step through them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.errors import BucketNotFound
from keyloom.functions.codec import (
    as_bytes, check_name, check_path, decode_path, encode_path, internal_key, meta_key, stored_key_column,
)
from keyloom.functions.hashing import BloomFilter, bloom_of
from keyloom.operators.bounds import has_prefix, in_range
from keyloom.operators.metrics import ObservedScan, ScanMetrics, scan_metrics

Path = tuple[bytes, ...]


@dataclass
class IterOptions:
    """Hints of a scan. Spark reads ahead by itself; the hints change nothing."""

    prefetch_count: int = 0
    collect_metrics: bool = False
    forward_only: bool = True


class View:
    """One namespace of a relation: the root, a bucket or a nested bucket."""

    def __init__(self, kv: DataFrame, path: Path = ()):
        self.kv, self.path, self.ns = kv, path, encode_path(path)
        self.rows = kv.where(F.col("ns") == F.lit(self.ns)).select("key", "value")

    @property
    def name(self) -> bytes:
        return self.path[-1] if self.path else b""

    def get_df(self, key) -> DataFrame:
        return self.rows.where(F.col("key") == F.lit(as_bytes(key)))

    def get(self, key) -> bytes | None:
        row = self.get_df(key).select("value").head()
        return None if row is None else bytes(row["value"])

    get_ref = get_borrowed = get_owned = get

    def contains(self, key) -> bool:
        return not self.get_df(key).select("key").isEmpty()

    def multi_get(self, keys: DataFrame | Iterable[bytes], key: str = "key") -> DataFrame:
        """key, value, found of each key asked for; found tells an absent key from an empty value."""
        if not isinstance(keys, DataFrame):
            keys = self.kv.sparkSession.createDataFrame([(as_bytes(k),) for k in keys], "key binary")
            key = "key"
        asked = keys.select(F.col(key).cast("binary").alias("key"))
        hits = self.rows.withColumn("found", F.lit(True))
        return asked.join(hits, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def present(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.rows.select("key"), "key", "left_semi")

    def missing(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.rows.select("key"), "key", "left_anti")

    def scan(self, reverse: bool = False) -> DataFrame:
        return self.rows.orderBy(F.desc("key") if reverse else F.asc("key"))

    def keys(self) -> DataFrame:
        return self.rows.select("key").orderBy("key")

    def range(self, start=None, end=None, reverse: bool = False) -> DataFrame:
        """start <= key < end; pass Bound objects for other bounds."""
        return self.rows.where(in_range(F.col("key"), start, end)).orderBy(F.desc("key") if reverse else F.asc("key"))

    def prefix(self, prefix) -> DataFrame:
        return self.rows.where(has_prefix(F.col("key"), prefix)).orderBy("key")

    def multi_range(self, ranges: DataFrame) -> DataFrame:
        """Entries of many ranges (lo, hi: half open), one row a range and entry. Pass ranges that fit
        a broadcast; the plan is then one pass over the namespace."""
        return self.rows.join(ranges, (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))

    def first(self, n: int = 1, reverse: bool = False) -> DataFrame:
        return self.scan(reverse).limit(n)

    def count(self) -> int:
        return self.rows.count()

    __len__ = count

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def iterate(self) -> Iterator[tuple[bytes, bytes]]:
        """Steps through the namespace in order, a partition at a time."""
        return ((bytes(r["key"]), bytes(r["value"])) for r in self.scan().toLocalIterator())

    def metrics(self) -> DataFrame:
        return scan_metrics(self.rows)

    def scan_observed(self) -> ObservedScan:
        return ObservedScan(self.scan())


@dataclass
class ReadView:
    """A consistent state: its entries and the paths of its buckets."""

    kv: DataFrame
    buckets: frozenset[Path] = field(default_factory=frozenset)

    def __post_init__(self):
        self.root = View(self.kv)

    # root namespace -------------------------------------------------
    def __getattr__(self, name):
        if name in ("get", "get_ref", "get_borrowed", "get_owned", "get_df", "contains", "multi_get", "present", "missing", "scan", "keys", "range",
                    "prefix", "multi_range", "first", "iterate"):
            return getattr(self.root, name)
        raise AttributeError(name)

    def iter(self, options: IterOptions | None = None) -> DataFrame:
        """All entries under their one-map keys, bucket marks included, in key order."""
        data = self.kv.select(stored_key_column(F.col("ns"), F.col("key")).alias("key"), "value")
        marks = self.kv.sparkSession.createDataFrame([(meta_key(p), b"") for p in self.buckets], "key binary, value binary")
        return data.unionByName(marks).orderBy("key")

    iter_with_options = iter

    def iter_with_metrics(self) -> ObservedScan:
        return ObservedScan(self.iter())

    def paths(self) -> list[Path]:
        return sorted(self.buckets, key=lambda p: (len(p), encode_path(p)))

    def bloom(self, fpp: float = 0.01) -> BloomFilter:
        """A filter of all one-map keys, made at the first call and kept with the view."""
        if "_bloom" not in self.__dict__:
            keys = self.kv.select(stored_key_column(F.col("ns"), F.col("key")).alias("key"))
            self.__dict__["_bloom"] = bloom_of(keys, "key", keys.count(), fpp)
        return self.__dict__["_bloom"]

    def may_contain_key(self, key, path: Path = ()) -> bool:
        """False only if the key isn't there; answered by the filter, without a read."""
        return bool(self.bloom().may_contain(internal_key(tuple(map(as_bytes, path)), as_bytes(key)))[0])

    def count(self) -> int:
        """Entries of all namespaces and marks of buckets."""
        return self.kv.count() + len(self.buckets)

    def is_empty(self) -> bool:
        return not self.buckets and self.kv.isEmpty()

    def internal_get(self, key: bytes) -> bytes | None:
        """An entry by its one-map key."""
        for p in self.paths():
            if key == meta_key(p):
                return b""
            prefix = internal_key(p, b"")
            if key.startswith(prefix) and (v := View(self.kv, p).get(key[len(prefix) :])) is not None:
                return v
        return self.root.get(key)

    # buckets --------------------------------------------------------
    def bucket(self, name) -> View:
        return self._view((check_name(name),))

    def nested_bucket(self, parent, child) -> View:
        return self._view(check_path((parent, child)))

    def nested_bucket_at_path(self, path) -> View:
        path = check_path(path)
        if len(path) < 2:
            raise BucketNotFound(f"{path!r} is no nested path")
        return self._view(path)

    def _view(self, path: Path) -> View:
        if path not in self.buckets:
            raise BucketNotFound(repr(path))
        return View(self.kv, path)

    def bucket_exists(self, name) -> bool:
        return (as_bytes(name),) in self.buckets

    def nested_bucket_exists(self, parent, child) -> bool:
        return (as_bytes(parent), as_bytes(child)) in self.buckets

    def nested_bucket_exists_at_path(self, path) -> bool:
        path = tuple(map(as_bytes, path))
        return len(path) >= 2 and path in self.buckets

    def list_buckets(self) -> list[bytes]:
        """Names of top-level buckets, shorter ones first, then by bytes."""
        return sorted((p[0] for p in self.buckets if len(p) == 1), key=lambda n: (len(n), n))

    def list_nested_buckets(self, parent) -> list[bytes]:
        return self.list_nested_buckets_at_path((parent,))

    def list_nested_buckets_at_path(self, path) -> list[bytes]:
        path = check_path(path)
        if path not in self.buckets:
            raise BucketNotFound(repr(path))
        return sorted((p[-1] for p in self.buckets if p[:-1] == path), key=lambda n: (len(n), n))

    def catalog(self) -> DataFrame:
        """ns, depth, name of every bucket, as a table."""
        rows = [(encode_path(p), len(p), p[-1]) for p in self.paths()]
        return self.kv.sparkSession.createDataFrame(rows, "ns binary, depth int, name binary")


def paths_of(kv: DataFrame) -> DataFrame:
    """The distinct namespaces that hold entries."""
    return kv.select("ns").distinct()


__all__ = ["IterOptions", "ReadView", "ScanMetrics", "View", "decode_path", "paths_of"]
