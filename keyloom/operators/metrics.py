"""Scan metrics."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScanMetrics:
    keys_scanned: int
    bytes_read: int
    seconds: float
    leaf_nodes_visited: int = 0
    branch_nodes_traversed: int = 0
    cache_hit_ratio: float = -1.0

    def avg_bytes_per_key(self) -> float:
        return self.bytes_read / self.keys_scanned if self.keys_scanned else 0.0

    def keys_per_second(self) -> float:
        return self.keys_scanned / self.seconds if self.seconds else 0.0

    def bytes_per_second(self) -> float:
        return self.bytes_read / self.seconds if self.seconds else 0.0


def measures(key: Column, value: Column) -> list[Column]:
    size = (F.octet_length(key) + F.octet_length(value)).cast("long")
    return [F.count(F.lit(1)).alias("keys_scanned"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("bytes_read")]


def scan_metrics(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """keys_scanned, bytes_read, avg_bytes_per_key as one row."""
    out = df.agg(*measures(F.col(key), F.col(value)))
    avg = F.when(F.col("keys_scanned") == 0, 0.0).otherwise(F.col("bytes_read") / F.col("keys_scanned"))
    return out.withColumn("avg_bytes_per_key", avg.cast("double"))


class ObservedScan:
    """A scan that counts while it is consumed: use .df once, then .metrics()."""

    def __init__(self, df: DataFrame, key: str = "key", value: str = "value"):
        self.observation, self.began = Observation(), time.time()
        self.df = df.observe(self.observation, *measures(F.col(key), F.col(value)))

    def metrics(self) -> ScanMetrics:
        got = self.observation.get
        return ScanMetrics(got["keys_scanned"], got["bytes_read"], time.time() - self.began)
