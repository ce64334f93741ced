"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the graph of nearest neighbours is cut into parts of nearly equal size (moves
of nodes to the part that most of their neighbours are in, within a capacity), and a small softmax
classifier with one hidden layer learns the parts that a vector's neighbours are in. Every row of
the table is then indexed under its most probable part; a handicap for each part, set over all rows
in a few rounds of counting, keeps every part within BALANCE times the mean, as far as different
vectors can be told apart (copies of one vector stay together). A query is routed to its most
probable parts, as many as held-out sample queries need for the wanted recall, and all their rows
are reranked by exact inner product. Parts grow with the table, one for PART_ROWS rows from
LEAST_PARTS to MOST_PARTS, with no fewer than two as soon as there are two rows; a part of many rows
is dealt over several tasks.

Bounded sample: SAMPLE vectors, or PART_SAMPLE for each part where that is more. Where vectors have
no structure (random directions), neighbours lie in most parts and most must be opened; the gain
comes with clusters.

Vectors that are null or zero or hold null or non-finite components take no part, nor do rows of a
null id; shorter vectors count as filled up with zeros. Equal scores go to smaller ids. A query id
that repeats is searched once, with the smallest of its vectors; its id is no candidate for itself.
Repeated rows of other ids are candidates each. An empty table gives no rows. Other columns are not
looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import stash
from keyloom.llm.vectors import BLOCK, QUERIES, best_of_block, matrix, merged, pack, ranked, salted, sample_matrix, unpacked, usable

SAMPLE, PART_SAMPLE, HELD_OUT, NEIGHBOURS, HIDDEN = 6_000, 24, 500, 20, 64
#: Rows a part should hold, and the fewest and most parts.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 12, 2048
#: The greatest part may hold this multiple of the mean; rounds of counting to get there.
BALANCE, ROUNDS = 1.25, 12
RECALL = 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_lists(q: np.ndarray, x: np.ndarray, k: int, same: bool) -> np.ndarray:
    out = []
    for i in range(0, len(q), 512):
        s = q[i : i + 512] @ x.T
        if same:
            s[np.arange(len(s)), i + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """The part of each node: begun by halving along main axes, then improved over the graph's
    links; no part gets more than 1.1 times its share."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        own, n, first = todo.pop()
        part[own] = first
        if n > 1 and len(own):
            axis = np.linalg.svd(x[own[:2000]] - x[own].mean(0), full_matrices=False)[2][0]
            order = own[np.argsort(x[own] @ axis, kind="stable")]
            cut = len(own) * (n // 2) // n
            todo += [(order[:cut], n // 2, first), (order[cut:], n - n // 2, first + n // 2)]
    room = int(np.ceil(1.1 * len(x) / parts))
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    for _ in range(rounds):
        key, votes = np.unique(np.concatenate([a * parts + part[b], b * parts + part[a]]), return_counts=True)
        node, of = np.divmod(key, parts)
        mine = np.zeros(len(x), np.int64)
        mine[node[of == part[node]]] = votes[of == part[node]]
        best = np.lexsort((of, -votes, node))
        best = best[np.append(True, node[best][1:] != node[best][:-1])]
        moves = np.stack([node[best], of[best], votes[best] - mine[node[best]]], 1)
        moves = moves[moves[:, 2] > 0]
        moves = moves[np.argsort(-moves[:, 2], kind="stable")]
        moved, count = 0, np.bincount(part, minlength=parts)
        for i, to, _ in moves.tolist():
            if count[to] < room:
                count[part[i]] -= 1
                count[to] += 1
                part[i] = to
                moved += 1
        if moved < max(1, len(x) // 200):
            break
    return part


class Router:
    """A softmax classifier with one hidden layer, fitted by Adam in numpy. near: the parts of each
    vector's neighbours."""

    def __init__(self, x: np.ndarray, near: np.ndarray, parts: int, hidden: int = HIDDEN, steps: int = 400):
        rng = np.random.default_rng(3)
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
        self.w = [rng.normal(0, 1 / np.sqrt(max(s[0], 1)), s) if len(s) > 1 else np.zeros(s) for s in shapes]
        self.handicap = np.zeros(parts)
        m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for t in range(1, steps + 1):
            rows = rng.integers(len(x), size=min(len(x), 1024))
            xb, yb = x[rows], np.zeros((len(rows), parts))
            np.add.at(yb, (np.arange(len(rows))[:, None], near[rows]), 1 / near.shape[1])
            h = np.tanh(xb @ self.w[0] + self.w[1])
            z = h @ self.w[2] + self.w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - yb) / len(rows)
            dh = (d @ self.w[2].T) * (1 - h * h)
            for i, g in enumerate([xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(_unit(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3] - self.handicap

    def order(self, x: np.ndarray, count: int | None = None) -> np.ndarray:
        """The parts of each vector, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :count]


def even(router: Router, counts, step: float = 0.7) -> np.ndarray:
    """Sets the handicaps: where counts(router), the rows that fall to each part, are uneven, full parts
    get a greater one. Keeps the evenest of ROUNDS rounds and returns its counts."""
    best = None
    for i in range(ROUNDS):
        n = counts(router)
        mean = max(n.mean(), 1e-9)
        if best is None or n.max() < best[0].max():
            best = (n, router.handicap)
        if n.max() <= BALANCE * mean:
            break
        router.handicap = router.handicap + step * np.log((n + 0.1 * mean) / (1.1 * mean))
        step *= 0.9
    router.handicap = best[1]
    return best[0]


def fit(sample: np.ndarray, parts: int) -> Router:
    """The router of the sample. Neighbours are by inner product, as in the rerank; the router sees
    directions alone, for a query's length doesn't change its order."""
    x = _unit(sample)
    near = neighbour_lists(sample, sample, max(1, min(NEIGHBOURS, len(x) - 1)), len(x) > 1)
    part = balanced_parts(x, near, parts)
    router = Router(x, part[near], parts)
    even(router, lambda r: np.bincount(r.order(x, 1)[:, 0], minlength=parts))
    return router


def opened_parts(router: Router, sample: np.ndarray, held: np.ndarray, k: int, recall: float) -> int:
    """How many parts held-out queries need for `recall` of their k nearest in the sample."""
    parts = len(router.handicap)
    if not len(held):
        return parts
    home = router.order(sample, 1)[:, 0]
    place = np.argsort(router.order(held), axis=1)
    true = neighbour_lists(held, sample, min(k, len(sample)), False)
    needed = np.take_along_axis(place, home[true], 1)
    reached = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    return int(np.argmax(reached >= recall)) + 1


def learn(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> tuple[Router, int]:
    """The router and the number of parts that a query opens, from a sample alone."""
    held = min(HELD_OUT, len(sample) // 5)
    router = fit(sample[held:], parts)
    return router, opened_parts(router, sample[held:], sample[:held], k, recall)


def part_count(n: int) -> int:
    return max(min(n, 2), min(max(LEAST_PARTS, min(n // PART_ROWS, MOST_PARTS)), n // 20))


class Index:
    """Every row of a table (vec_id, vector) under its part: blocks, their join keys, the router, the
    rows in each part and the number of parts that a query opens."""

    def __init__(self, vectors: DataFrame, dim: int, k: int = 20, recall: float = RECALL):
        vectors = stash(vectors, "vectors")
        self.dim, self.k, self.n = dim, k, vectors.count()
        if not self.n:
            return
        parts = part_count(self.n)
        sample = sample_matrix(vectors, max(SAMPLE, PART_SAMPLE * parts), dim)
        held = min(HELD_OUT, len(sample) // 5)
        self.router = fit(sample[held:], parts)
        # The handicaps are set again by counting all rows: a row of numbers from each task.
        self.counts = even(self.router, lambda router: part_sizes(vectors, router, dim))
        self.probes = opened_parts(self.router, sample[held:], sample[:held], k, recall)
        blocks = stash(pack(self._routed(vectors, 1), dim, BLOCK), "parts")
        self.blocks, cells = salted(blocks)
        self.keys = stash(cells.select("cell", "part"), "keys")

    def _routed(self, rows: DataFrame, count: int) -> DataFrame:
        router, dim = self.router, self.dim

        def run(batches):
            for batch in batches:
                order = router.order(matrix(batch.column(1), dim), count)
                at = np.repeat(np.arange(len(order)), order.shape[1])
                taken = batch.take(pa.array(at))
                columns = [pa.array(order.ravel().astype(np.int32)), pa.array(np.zeros(len(at))), *taken.columns]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "at", *batch.schema.names])

        return rows.select("vec_id", "vector").mapInArrow(run, "cell int, at double, vec_id long, vector array<double>")

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score: the nearest found of each query (vec_id, vector)."""
        if not self.n:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        dim, k = self.dim, self.k
        queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
        asked = pack(self._routed(queries, self.probes), dim, QUERIES).join(self.keys, "cell")
        asked = asked.select("cell", "part", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "extra")])

        def opened(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ids, x, _ = unpacked(row, dim)
                    q_ids, q, _ = unpacked(row, dim, "q_")
                    yield best_of_block(q_ids, q, ids, x, k, np.full(len(q_ids), -np.inf))

        def rerank(batches):
            yield from merged(opened(batches), k)

        found = self.blocks.select("cell", "part", "ids", "rows", "extra").join(asked, ["cell", "part"])
        return ranked(found.mapInArrow(rerank, "query_id long, vec_id long, score double"), k)


def part_sizes(vectors: DataFrame, router: Router, dim: int) -> np.ndarray:
    """How many rows fall to each part."""
    parts = len(router.handicap)

    def count(batches):
        n = np.zeros(parts, np.int64)
        for batch in batches:
            n += np.bincount(router.order(matrix(batch.column(0), dim), 1)[:, 0], minlength=parts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["part", "n"])

    out = np.zeros(parts, np.int64)
    for r in vectors.select("vector").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        out[r["part"]] = r["n"]  # at most MOST_PARTS rows
    return out


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of the rows whose id `every` divides, among all other rows."""
    rows, dim = usable(embeddings)
    rows = rows.where("exists(vector, x -> x <> 0)")
    return Index(rows, dim, k).search(rows.where(F.col("vec_id") % every == 0))
