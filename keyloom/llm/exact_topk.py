"""Exact top-k by a pivot-distance index.

Inner products become distances by one more component: with M the largest norm, x' = (x, sqrt(M^2
- |x|^2)) and q' = (q, 0), so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest
pivot and the distance to it; rows sorted by that key are cut into annuli (blocks), which also note
the least and greatest distance of their vectors to REFERENCES pivots. A query first searches the
annuli around its own key; its k-th score there gives a radius. By the triangle inequality only
annuli that for every noted pivot p overlap [d(q, p) - radius, d(q, p) + radius] can hold better
vectors, and only those are opened, for queries in blocks. All rows are indexed; pivots come from
a bounded sample, which changes cost and never results. Their number grows with the rows, and a cell
of many annuli is dealt over several tasks.

Vectors that are null or hold null or non-finite components take no part, nor do rows of a null id.
Shorter vectors count as filled up with zeros; an empty one is a zero vector. Equal scores go to
smaller ids. A query id that repeats is searched once, with the smallest of its vectors; its id is
no candidate for itself. Repeated rows of other ids are candidates each. An empty table gives no
rows. Scores of whole numbers are exact; one that doesn't fit a long is an error. Other columns are
not looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import stash
from keyloom.llm.vectors import BLOCK, QUERIES, best_of_block, matrix, merged, pack, ranked, salted, sample_matrix, unpacked, usable

#: Pivots: the root of the number of rows, within these numbers; a sample of so many vectors for each.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, PIVOT_SAMPLE = 32, 4096, 4096, 8
#: Pivots whose distances bound an annulus, beside its own.
REFERENCES = 16


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _flat(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Means of a few rounds of k-means, begun at points far from each other; in the order of their
    main axis, so that cells of near numbers are near."""
    if len(x) <= count:
        return x
    chosen = [0]
    far = _distances(x, x[:1])[:, 0]
    while len(chosen) < count:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    centres = x[chosen]
    for _ in range(8):
        own = _distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=count)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    main = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    return centres[np.argsort(centres @ main, kind="stable")]


def search(
    vectors: DataFrame, queries: DataFrame, dim: int, k: int = 10, pivots: int | None = None, whole: bool = False, count_opened: bool = False
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query among all vectors.
    Both tables: vec_id, vector; without nulls and of one dimension. whole: components are whole
    numbers, and scores exact longs. count_opened: instead, one row of `opened`, the pairs of a query
    and a vector that the second round scores."""
    kind = "long" if whole else "double"
    vectors = stash(vectors, "vectors")
    norm = F.expr("aggregate(vector, 0d, (s, x) -> s + x * x)")
    n, top = vectors.agg(F.count("*"), F.max(norm)).head()
    queries = stash(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    top = max(top or 0.0, queries.agg(F.max(norm)).head()[0] or 0.0)
    if not n:
        return vectors.sparkSession.createDataFrame([], "opened long" if count_opened else f"query_id long, rank int, vec_id long, score {kind}")
    pivots = pivots or min(max(LEAST_PIVOTS, int(n**0.5)), MOST_PIVOTS)
    centre = choose_pivots(_lifted(sample_matrix(vectors, max(SAMPLE, PIVOT_SAMPLE * pivots), dim), top), pivots)
    near_by = centre[np.linspace(0, len(centre) - 1, min(REFERENCES, len(centre))).astype(int)]
    slack = 1e-6 * (1 + np.sqrt(top))  # more than what rounding does to a distance

    def keyed(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            d = _distances(_lifted(x, top), centre)
            own = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own]), *batch.columns], ["cell", "at", *batch.schema.names]
            )

    def bounds(x: np.ndarray) -> np.ndarray:
        d = _distances(_lifted(x, top), near_by)
        return np.stack([d.min(0), d.max(0)])

    key = "cell int, at double, vec_id long, vector array<double>"
    blocks = stash(pack(vectors.select("vec_id", "vector").mapInArrow(keyed, key), dim, BLOCK, summary=bounds), "annuli")
    blocks, cells = salted(blocks)
    cells = stash(cells, "cells")
    own = queries.select("vec_id", "vector").mapInArrow(keyed, key)

    def radius(q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1) + top - 2 * floor, 0)) + slack

    def pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["rows"], np.float64).reshape(len(ids), dim)
                q_ids, q, floor = unpacked(row, dim, "q_")
                if row["q_far"]:  # per query, the triangle inequality for each pivot
                    low, high = np.frombuffer(row["extra"], np.float64).reshape(2, -1)
                    r = radius(q, floor)[:, None]
                    d = _distances(_flat(q), near_by)
                    some = ((d - r <= high + slack) & (d + r >= low - slack)).all(1)
                    d = _distances(_flat(q), centre[row["cell"]][None])
                    some &= ((d - r <= row["hi"] + slack) & (d + r >= row["lo"] - slack))[:, 0]
                    q_ids, q, floor = q_ids[some], q[some], floor[some]
                yield ids, x, q_ids, q, floor

    def open_annuli(batches):
        yield from merged((best_of_block(q_ids, q, ids, x, k, floor, whole) for ids, x, q_ids, q, floor in pairs(batches)), k)

    def count(batches):
        n = sum(len(ids) * len(q_ids) for ids, _, q_ids, _, _ in pairs(batches))
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["opened"])

    def opened(asked, far):
        """asked: packed queries with the cell and part they ask for."""
        asked = asked.select(
            F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"),
            F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("extra").alias("q_extra"), F.lit(far).alias("q_far"),
        )
        same = (F.col("cell") == F.col("q_cell")) & (F.col("part") == F.col("q_part"))
        both = blocks.join(asked, same & (F.col("lo") <= F.col("q_hi")) & (F.col("hi") >= F.col("q_lo")))
        if far and count_opened:
            return both.mapInArrow(count, "opened long").agg(F.sum("opened").alias("opened"))
        return both.mapInArrow(open_annuli, f"query_id long, vec_id long, score {kind}")

    # Round 1: the annuli at the queries' own keys, without a floor.
    near = pack(own.withColumn("floor", F.lit(float("-inf"))), dim, QUERIES, "floor")
    first = ranked(opened(near.join(cells.select("cell", "part"), "cell"), False), k).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.count("*").alias("n"), F.min("score").cast("double").alias("least")
    )
    floor = F.when(F.col("n") >= k, F.col("least") - F.abs("least") * 1e-15).otherwise(F.lit(float("-inf")))
    asked = stash(own.join(first, "vec_id", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf")))).drop("n", "least"), "floors")

    # Round 2: every annulus that the radius reaches, in every cell that it reaches.
    extent = {r["cell"]: (r["lo"], r["hi"]) for r in cells.select("cell", "lo", "hi").distinct().collect()}  # at most MOST_PIVOTS rows

    def reach(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, q, floor = unpacked(row, dim)
                r = radius(q, floor)[:, None]
                d = _distances(_flat(q), centre)
                low, high = d - r - slack, d + r + slack
                rows = []
                for c, (lo, hi) in extent.items():
                    some = (low[:, c] <= hi) & (high[:, c] >= lo)
                    if some.any():
                        rows.append(row | {"cell": c, "lo": low[some, c].min(), "hi": high[some, c].max()})
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    # Queries of neighbouring cells share blocks, so that few queries a cell don't make many blocks.
    packed = pack(asked.withColumn("at", F.col("cell") + F.col("at") / (2 * np.sqrt(top) + 2)).withColumn("cell", F.lit(0)), dim, QUERIES, "floor")
    far = packed.mapInArrow(reach, packed.schema).join(cells.select("cell", "part"), "cell")
    return opened(far, True) if count_opened else ranked(opened(far, True), k)


def whole_vectors(embeddings: DataFrame, scale: int = 1024) -> tuple[DataFrame, int]:
    """floor(scale * x) of each component, as a double: from 2^53 on doubles are whole already."""
    rows, dim = usable(embeddings)
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return rows.withColumn("vector", F.transform("vector", whole)), dim


def integer_topk(embeddings: DataFrame, every: int = 100, scale: int = 1024, k: int = 10) -> DataFrame:
    """Top k by the inner product of floor(scale * x); queries are the rows whose id `every` divides."""
    rows, dim = whole_vectors(embeddings, scale)
    return search(rows, rows.where(F.col("vec_id") % every == 0), dim, k, whole=True)
