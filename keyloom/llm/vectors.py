"""Vectors as packed blocks: cleaning, packing of sorted rows, exact scoring of block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of the index, and queries in a block.
BLOCK, QUERIES = 2048, 256
#: Blocks of one cell that a join key holds; a cell of more has several keys.
CELL_BLOCKS = 64


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector array<double>) of the rows that take part, and their dimension, the greatest
    length. Shorter vectors are filled up with zeros, which leaves all inner products as they are.
    Rows with a null id, a null vector, or a null or non-finite component take no part."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("vec_id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    dim = max(rows.agg(F.max(F.size("vector"))).head()[0] or 0, 1)
    zeros = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vector"))
    return rows.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.concat("vector", zeros))), dim


def sample_matrix(rows: DataFrame, most: int, dim: int) -> np.ndarray:
    """At most `most` vectors by hash of the id, as a matrix on the driver."""
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(most).select("vector").collect()
    return np.array([r["vector"] for r in got], np.float64).reshape(len(got), dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


PACKED = "cell int, lo double, hi double, ids binary, rows binary, extra binary"


def pack(rows: DataFrame, dim: int, size: int, extra: str | None = None, summary=None) -> DataFrame:
    """Blocks of at most `size` rows of one cell that follow each other in the order (cell, at,
    vec_id): the range of `at`, ids, vectors and, as bytes, an extra number of each row or what
    summary makes of the vectors. Range partitioning splits a cell of many rows over tasks."""

    def run(batches):
        wait: list[tuple] = []
        cell, waiting = None, 0

        def block():
            ids, at, x, e = (np.concatenate(c) for c in zip(*wait))
            e = summary(x) if summary else e
            return pa.RecordBatch.from_pylist(
                [{"cell": cell, "lo": at.min(), "hi": at.max(), "ids": ids.tobytes(), "rows": x.tobytes(), "extra": e.tobytes()}],
                pa.schema([("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), *((c, pa.binary()) for c in ("ids", "rows", "extra"))]),
            )

        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            at = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(3), dim)
            e = batch.column(4).to_numpy(zero_copy_only=False) if extra else np.zeros(len(ids))
            first = 0
            while first < len(ids):
                if wait and (cells[first] != cell or waiting >= size):
                    yield block()
                    wait, waiting = [], 0
                cell = int(cells[first])
                last = first + int(np.searchsorted(cells[first:], cell, "right"))
                last = min(last, first + size - waiting)
                wait.append((ids[first:last], at[first:last], x[first:last], e[first:last]))
                waiting += last - first
                first = last
        if wait:
            yield block()

    columns = ["cell", "at", "vec_id", "vector", *([extra] if extra else [])]
    return rows.repartitionByRange("cell", "at", "vec_id").sortWithinPartitions("cell", "at", "vec_id").select(*columns).mapInArrow(run, PACKED)


def salted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with a part number, keys): cells of many blocks are several join keys; keys: cell, lo,
    hi, n (blocks) and part, a row for each of them. What asks for a cell asks for each of its parts."""
    cells = blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / CELL_BLOCKS))
    named = blocks.join(cells.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
    return named, cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")


def unpacked(row: dict, dim: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    return ids, np.frombuffer(row[prefix + "rows"], np.float64).reshape(len(ids), dim), np.frombuffer(row[prefix + "extra"], np.float64)


def products(q: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products of the rows of q with those of x, summed in one fixed order, so that equal vectors
    give equal ones. whole: of integers, exactly, as int64; an OverflowError where one doesn't fit."""
    if not whole:
        return np.multiply(q, x).sum(1)
    if not len(q):
        return np.zeros(0, np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2.0**53:
        return np.multiply(q, x).sum(1).astype(np.int64)
    if most < 2.0**62:
        return np.multiply(q.astype(np.int64), x.astype(np.int64)).sum(1)
    exact = [sum(int(a) * int(b) for a, b in zip(*rows)) for rows in zip(q.tolist(), x.tolist())]
    return np.array(exact, np.int64)  # numpy raises where one doesn't fit


def best_of_block(query_ids, queries, ids, x, k: int, floor: np.ndarray, whole: bool = False):
    """(query id, id, score) of the k largest inner products of each query that reach its floor;
    equal scores go to smaller ids, a query's own id is left out. Candidates come from a matrix
    product; their scores are computed again by `products`."""
    rough = queries @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(queries).sum(1) * (np.abs(x).max() if x.size else 0))
    bar = floor - slack
    if len(ids) > k:
        bar = np.maximum(bar, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * slack)
    q, c = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
    score = products(queries[q], x[c], whole)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, np.arange(len(query_ids)))
    keep = (np.arange(len(q)) - first[q] < k) & (score >= floor[q])
    return query_ids[q[keep]], ids[c[keep]], score[keep]


def merged(found, k: int, most: int = 200_000):
    """Record batches of (query_id, vec_id, score) from such triples of arrays, reduced to the k best of
    each query within the task, so that a query's blocks in one task give k rows and not k each."""
    wait: list[tuple] = []

    def reduced() -> tuple:
        q, c, s = (np.concatenate(x) for x in zip(*wait))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
        return q[keep], c[keep], s[keep]

    def batch(t) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in t], ["query_id", "vec_id", "score"])

    size = 0
    for triple in found:
        if len(triple[0]):
            wait.append(triple)
            size += len(triple[0])
        if size > most:
            wait = [reduced()]
            size = len(wait[0][0])
            if size > most // 2:  # many queries: their rows go on, later blocks add theirs
                yield batch(wait[0])
                wait, size = [], 0
    if wait:
        yield batch(reduced())


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
