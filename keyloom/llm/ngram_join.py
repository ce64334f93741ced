"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The matrix has a row for each different n-gram set and a column for each n-gram. Rows' columns
are in one global order, rare ones first. Two rows whose Jaccard similarity reaches the threshold
share a column among the first n - ceil(threshold * n) + 1 of each; so the product of this part of
the matrix, by blocks of columns (partitions of the shuffle), has all pairs that can link. Pairs
whose sizes, or whose numbers of columns left, cannot give the needed overlap are discarded there.
For the others the overlap is accumulated over blocks of columns of the whole rows, and a pair is
dropped as soon as the columns left cannot bring it to the bound. Before whole rows meet, the
parities of their numbers of columns in cells give an upper bound of the overlap.

Rows of equal sets are one row of the matrix, so copies cost nothing. Within a large group of near
copies not all pairs are formed: each row is first compared with one hub, a row that shares its
columns with many. If a row A has less in common with its hub H than any link of A needs, whatever
links with A shares columns with it that H lacks; so pairs of rows compared with the same hub are
found through the first of the columns that H lacks (again by the prefix bound), which in a group
of near copies are few and rare. Other pairs are found through the first columns of the rows. Pairs
already in one component are not formed. Only the cost depends on the hubs: every link between
rows of different components is checked exactly.

What grows without a bound in one task is nothing: pairs are made by equi-joins on columns that
Spark deals out, and rows of one component are looked up under many keys. The driver gets maps of
fixed size alone. Worst case: rows of one column that share no hub and aren't linked are compared
pairwise as far as their sizes and places allow, so texts made of common passages alone, each in
another choice, cost the square of their number for such a passage.

Rows are documents. Ties between hubs go to the greater id, which changes no result. An empty table
gives no rows. Null or empty texts, and texts without words, have no n-grams, n_shingles 0
and link with nothing. Rows with a null id take part in no link and get a null component_id.
Rows that repeat an id stay separate rows. Other columns are not looked at."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.shared import (
    CHUNK, Words, components, free_name, give_back, shingles, short_batches, stash, sweep, text_chunks, unstash,
)

#: Columns (n-grams) are counted in 2 ** BITS cells; the counts only order the columns.
BITS, CELLS_A_ROW = 20, 1 << 14
#: Blocks of columns in which overlaps are accumulated.
COLUMN_BLOCKS = 8
#: Pairs compared at once in a task.
PAIRS = 256
#: Rows of a batch that a worker gets, and bytes of text whose n-grams it makes at once.
BATCH, PIECE = 1000, CHUNK // 4
#: Bits of the marks of documents whose rows are asked for.
MARKS, MARK_PIECE = 1 << 22, 1 << 14
#: Keys that a component's rows are dealt over when its smallest id is looked up.
SALTS = 64


def _sets(batch: pa.RecordBatch, k: int, keep=None):
    """(row, sorted distinct n-gram hashes) of each row, or of the rows for which keep holds."""
    texts = batch.column(batch.schema.get_field_index("text"))
    at = np.arange(len(texts)) if keep is None else np.flatnonzero(keep)
    if keep is not None:
        texts = texts.filter(pa.array(keep))
    for first, last, data, offsets in text_chunks(texts, PIECE):
        hashes, bounds = shingles(Words(data, offsets), k)
        for i in range(last - first):
            yield int(at[first + i]), np.unique(hashes[bounds[i] : bounds[i + 1]])


def column_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many rows hold n-grams of each of 2 ** BITS cells, over all documents, as the logarithm
    in steps of a quarter (one byte each): a table of fixed size, summed on the executors."""

    def count(batches):
        cells = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for _, s in _sets(batch, k):
                np.add.at(cells, (s & np.uint64((1 << BITS) - 1)).astype(np.int64), 1)
        blocks = cells.reshape(-1, CELLS_A_ROW)
        some = np.flatnonzero(blocks.any(1))
        salt = int(np.random.default_rng().integers(16))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32)),
                pa.array(np.full(len(some), salt, np.int32)),
                pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary()),
            ],
            ["block", "salt", "cells"],
        )
        give_back()

    def add(last):
        def run(key, table):
            total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64 if last else np.int32).astype(np.int64) for x in table.column("cells"))
            cells = (4 * np.log2(1 + total)).astype(np.uint8).tobytes() if last else zlib.compress(total.tobytes(), 1)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells], pa.binary())})

        return run

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "block int, salt int, cells binary")
    parts = parts.groupBy("block", "salt").applyInArrow(add(False), "block int, cells binary")
    parts = parts.groupBy("block").applyInArrow(add(True), "block int, cells binary")
    total = np.zeros(((1 << BITS) // CELLS_A_ROW, CELLS_A_ROW), np.uint8)
    for row in parts.toLocalIterator():  # 64 rows of 16 kB
        total[row["block"]] = np.frombuffer(bytes(row["cells"]), np.uint8)
    return total.ravel()


def _rows(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """doc_id, key (hash of the text), n (size of its set), node (digest of the set) and prefix (its
    rarest columns)."""
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def rows(batches):
        cells = order.value
        for batch in batches:
            ids = batch.select(["doc_id", "key"])
            at, n, node, prefix = [], [], [], []
            waiting = 0
            for i, s in _sets(batch, k):
                at.append(i)
                n.append(len(s))
                if not len(s):
                    node.append(None)
                    prefix.append(None)
                    continue
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                most = len(s) - -(-num * len(s) // den) + 1
                rare = np.argsort(cells[(s & np.uint64((1 << BITS) - 1)).astype(np.int64)], kind="stable")
                prefix.append(s[rare[:most]].view(np.int64))
                waiting += most
                if waiting > CHUNK // 8:
                    yield table(ids, at, n, node, prefix)
                    at, n, node, prefix, waiting = [], [], [], [], 0
            yield table(ids, at, n, node, prefix)
        give_back()

    def table(ids, at, n, node, prefix):
        return pa.RecordBatch.from_arrays(
            [
                *ids.take(pa.array(at, pa.int64())).columns, pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                pa.array(prefix, pa.list_(pa.int64())),
            ],
            ["doc_id", "key", "n", "node", "prefix"],
        )

    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return docs.mapInArrow(rows, "doc_id long, key long, n long, node binary, prefix array<long>")


def _fits(num: int, den: int) -> str:
    """Whether sizes and the columns left (at positions i and j) allow the needed overlap."""
    need = f"cast(ceil({num} * (a.n + b.n) / {num + den}) as long)"
    return f"least(a.n, b.n) * {den} >= greatest(a.n, b.n) * {num} and least(a.n - a.i, b.n - b.i) >= {need}"


def overlaps(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Overlap of each pair of sorted rows, accumulated over blocks of columns; a pair stops when
    what it has and the columns left cannot reach its bound (its count is then below it)."""
    size_l, size_r = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    cols = np.concatenate([*left, *right]) if left else np.zeros(0, np.uint64)
    pair = np.concatenate([np.repeat(np.arange(len(left)), size_l), np.repeat(np.arange(len(right)), size_r)])
    is_left = np.arange(len(cols)) < size_l.sum()
    block = (cols >> np.uint64(61)).astype(np.int64) * COLUMN_BLOCKS // 8
    got = np.zeros(len(left), np.int64)
    rest_l, rest_r = size_l.copy(), size_r.copy()
    alive = np.ones(len(left), bool)
    for b in range(COLUMN_BLOCKS):
        here = (block == b) & alive[pair]
        c, p, l = cols[here], pair[here], is_left[here]
        at = np.lexsort((c, p))
        c, p = c[at], p[at]
        both = (c[1:] == c[:-1]) & (p[1:] == p[:-1])
        got += np.bincount(p[1:][both], minlength=len(got))
        rest_l -= np.bincount(pair[here][l], minlength=len(got))
        rest_r -= np.bincount(pair[here][~l], minlength=len(got))
        alive &= got + np.minimum(rest_l, rest_r) >= need
    return got


def parities(row: np.ndarray) -> bytes:
    """Whether the number of the row's columns in each of m cells is odd, m bits; m is a power of two,
    the row's size or more."""
    m = max(64, 1 << int(len(row) - 1).bit_length()) if len(row) else 64
    return np.packbits(np.bincount((row & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1).tobytes()


def odd_columns(left: bytes, right: bytes) -> int:
    """A lower bound of the number of columns that one of two rows has and the other hasn't: a cell
    whose parities differ holds one at least. The finer parities are folded to the other's cells."""
    a, b = (np.frombuffer(x, np.uint8) for x in sorted((left, right), key=len))
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.unpackbits(a ^ b).sum())


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """The sides of each mark: a map of fixed size that skips the texts on neither side of a pair (the
    joins are exact). Its pieces are made on the executors."""

    def piece(key, table):
        sides = np.zeros(MARK_PIECE, np.uint8)
        np.bitwise_or.at(sides, table.column("at").to_numpy(), table.column("side").to_numpy().astype(np.uint8))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "sides": pa.array([zlib.compress(sides.tobytes(), 1)], pa.binary())})

    marks = wanted.groupBy("bit").agg(F.bit_or("side").alias("side"))  # at most MARK_PIECE rows a piece
    marks = marks.select(F.expr(f"cast(bit div {MARK_PIECE} as int)").alias("piece"), F.expr(f"cast(bit % {MARK_PIECE} as int)").alias("at"), "side")
    out = np.zeros((MARKS // MARK_PIECE, MARK_PIECE), np.uint8)
    for row in marks.groupBy("piece").applyInArrow(piece, "piece int, sides binary").toLocalIterator():  # 256 rows of 16 kB at most
        out[row["piece"]] = np.frombuffer(zlib.decompress(bytes(row["sides"])), np.uint8)
    return out.ravel()


def _products(
    docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, num: int, den: int, counts: np.ndarray | None, by_parity: bool = False
) -> DataFrame:
    """The pairs (a, b: ids of nodes) that link, by the exact overlap of their whole rows. With counts, all
    pairs: a, b, n (size of a), overlap and rest, the first columns of a that b lacks. A row travels
    as its compressed text, which is a quarter of its hashes, and is made again where pairs meet.
    With by_parity, the pairs that may link as far as the parities of their rows tell."""
    spark = docs.sparkSession
    named = nodes.select("id", F.col("node").alias("digest"), F.pmod(F.xxhash64("rep"), F.lit(MARKS)).alias("bit"))
    sides = pairs.select(F.col("a").alias("id"), F.lit(1).alias("side")).unionByName(pairs.select(F.col("b").alias("id"), F.lit(2).alias("side")))
    wanted = stash(named.join(sides.groupBy("id").agg(F.bit_or("side").alias("side")), "id"), "wanted")
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
    order = spark.sparkContext.broadcast(counts) if counts is not None else None

    def sets(batches):
        for batch in batches:
            side = bitmap.value[batch.column(batch.schema.get_field_index("bit")).to_numpy(zero_copy_only=False)]
            whole = batch.column(batch.schema.get_field_index("text"))
            found, waiting = [], 0
            for i, s in _sets(batch, k, side > 0):
                node = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                text = whole[i].as_buffer()
                found.append((node, int(side[i]), len(s), parities(s)) if by_parity else (node, int(side[i]), text.size, zlib.compress(text)))
                waiting += len(found[-1][3])
                if waiting > CHUNK:
                    yield table(found)
                    found, waiting = [], 0
            yield table(found)
        give_back()

    def table(found):
        node, side, size, row = zip(*found) if found else ((), (), (), ())
        columns = [pa.array(node, pa.binary()), pa.array(side, pa.int32()), pa.array(size, pa.int64()), pa.array(row, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["digest", "side", "size", "row"])

    texts = docs.where("doc_id is not null").select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARKS)).alias("bit"), F.coalesce("text", F.lit("")).alias("text")
    )
    # One row for each set: the map lets copies through by chance, and those of both sides of a pair would multiply it.
    found = texts.mapInArrow(sets, "digest binary, side int, size long, row binary").groupBy("digest").agg(
        F.bit_or("side").alias("side"), F.first(F.struct("size", "row")).alias("one")
    )
    rows = stash(found.select("digest", "side", "one.size", "one.row"), "rows")

    def product(batches):
        for batch in batches:
            if by_parity:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("size_a", "size_b", "row_a", "row_b")]
                most = (n + m - 2 * -(-num * (n + m) // (num + den)) for n, m in zip(*columns[:2]))
                keep = [odd_columns(x, y) <= d for x, y, d in zip(*columns[2:], most)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                continue
            size_l, size_r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b"))
            for at, length in runs(size_l + size_r):
                part = batch.slice(at, length)
                packed = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("row_a", "row_b")]
                once = list(dict.fromkeys([*packed[0], *packed[1]]))
                texts = pa.record_batch([pa.array([zlib.decompress(x) for x in once], pa.binary())], ["text"])
                of = dict(zip(once, (s for _, s in _sets(texts, k))))
                left, right = ([of[x] for x in side] for side in packed)
                n_l, n_r = (np.array([len(x) for x in side], np.int64) for side in (left, right))
                need = -(-num * (n_l + n_r) // (num + den))
                if order is None:
                    yield part.select(["a", "b"]).filter(pa.array(overlaps(left, right, need) >= need))
                    continue
                got = overlaps(left, right, np.zeros_like(need))
                rest = []
                for x, y in zip(left, right):
                    own = np.setdiff1d(x, y, assume_unique=True)
                    cells = order.value[(own & np.uint64((1 << BITS) - 1)).astype(np.int64)]
                    rest.append(own[np.argsort(cells, kind="stable")[: len(x) - -(-num * len(x) // den) + 1]].view(np.int64))
                columns = [pa.array(n_l), pa.array(got), pa.array(got >= need), pa.array(rest, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.select(["a", "b"]).columns, *columns], ["a", "b", "n", "overlap", "links", "rest"])
        give_back()

    def runs(sizes):
        """(first, length) of runs of at most PAIRS pairs and about CHUNK bytes of text, one pair at least."""
        first = 0
        ends = np.cumsum(sizes)
        while first < len(sizes):
            most = (ends[first - 1] if first else 0) + CHUNK
            last = min(max(first + 1, int(np.searchsorted(ends, most, "right"))), first + PAIRS)
            yield first, last - first
            first = last

    # Rows are long: they always meet their pairs by a shuffle, whatever the sizes, each side's rows alone.
    digest = wanted.select("id", "digest")
    asked = pairs.join(digest.select(F.col("id").alias("a"), F.col("digest").alias("digest_a")), "a")
    asked = asked.join(digest.select(F.col("id").alias("b"), F.col("digest").alias("digest_b")), "b")
    left = rows.where("side & 1 = 1").select(F.col("digest").alias("digest_a"), F.col("size").alias("size_a"), F.col("row").alias("row_a"))
    right = rows.where("side & 2 = 2").select(F.col("digest").alias("digest_b"), F.col("size").alias("size_b"), F.col("row").alias("row_b"))
    both = asked.join(left.hint("merge"), "digest_a").select("a", "b", "digest_b", "size_a", "row_a")
    both = both.join(right.hint("merge"), "digest_b").select("a", "b", "size_a", "size_b", "row_a", "row_b")
    more = "" if order is None else ", n long, overlap long, links boolean, rest array<long>"
    out = stash(both.mapInArrow(product, f"a long, b long{more}"), "products")
    unstash(rows)
    unstash(wanted)
    sweep(spark)
    return out


def near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_shingles and component_id of every row of docs (doc_id,
    text): documents link if
    den * overlap >= num * union of their sets of k-word n-grams; component_id is the smallest
    doc_id that links reach."""
    with short_batches(docs.sparkSession, BATCH):  # all Python runs in here: what is returned reads written tables
        return _near_copies(docs, k, num, den)


def _near_copies(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    counts = column_counts(docs, k)
    rows = stash(_rows(docs, k, num, den, counts), "docs")
    nodes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    # Ids are fixed once the table is written; they are shorter than digests in what follows, and in the order of rep.
    nodes = nodes.repartitionByRange("rep", "node").sortWithinPartitions("rep", "node")
    nodes = stash(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select(F.col("id").alias("node"), "n", F.posexplode("prefix").alias("i", "term"))
    shared = entries.groupBy("term").agg((F.count("*") - 1).alias("others")).where("others > 0")
    # Tables of entries always meet by a shuffle, so the plan is the same at every size.
    entries = entries.join(shared.hint("merge"), "term")
    entries = stash(entries.withColumn("weight", F.sum("others").over(Window.partitionBy("node"))).drop("others"), "entries")

    sweep(docs.sparkSession)
    # One hub for each row: of the rows that share one of its first columns, the one that shares most.
    hub = F.max(F.struct("weight", "node", "n", "i")).alias("hub")
    hubs = entries.groupBy("term").agg(hub).select("term", "hub.*")
    near = entries.alias("a").join(hubs.hint("merge").alias("b"), F.col("a.term") == F.col("b.term")).where(_fits(num, den))
    near = near.where("struct(b.weight, b.node) > struct(a.weight, a.node)").groupBy(F.col("a.node").alias("a")).agg(
        F.max(F.struct("b.weight", "b.node")).alias("hub")
    )
    near = stash(near.select("a", F.col("hub.node").alias("b")), "near")
    compared = _products(docs, nodes, near, k, num, den, counts)
    links = compared.where("links").select("a", "b")
    comp = components(links, "a", "b")

    under = compared.where(F.expr(f"links or overlap < cast(ceil({num} * n / {den}) as long)"))
    place = under.select(F.col("a").alias("node"), F.col("b").alias("cluster"))
    known = stash(
        place.join(comp, "node", "full").select(
            "node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("component", "node").alias("component")
        ),
        "known",
    )
    owned = entries.join(known.hint("merge"), "node", "left").select(
        "term", "node", "n", "i", F.coalesce("component", "node").alias("component"), F.coalesce("cluster", "node").alias("cluster")
    )
    split = owned.groupBy("term").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("term")
    owned = stash(owned.join(split.hint("merge"), "term", "left_semi"), "owned")
    unlike = "a.component <> b.component and a.node < b.node"
    first = owned.alias("a").join(owned.hint("merge").alias("b"), F.col("a.term") == F.col("b.term")).where(
        f"{unlike} and a.cluster <> b.cluster and {_fits(num, den)}"
    )
    rest = under.select(F.col("a").alias("node"), "n", F.explode("rest").alias("term")).join(known, "node")
    same = (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.term") == F.col("b.term"))
    second = rest.alias("a").join(rest.hint("merge").alias("b"), same).where(
        f"{unlike} and least(a.n, b.n) * {den} >= greatest(a.n, b.n) * {num}"
    )
    pairs = first.select("a.node", F.col("b.node").alias("other")).unionByName(second.select("a.node", F.col("b.node").alias("other")))
    pairs = stash(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    # Most of these pairs only share a part: parities tell, and whole rows meet for the others.
    likely = _products(docs, nodes, pairs, k, num, den, None, True)
    more = _products(docs, nodes, likely, k, num, den, None)
    comp = stash(_joined(comp, more), "joined")
    for done in (entries, owned, pairs, near):
        unstash(done)

    # Ids are in the order of rep, so the smallest id of a component has its smallest doc_id. Only rows
    # with links look it up, and those of one component under many keys.
    roots = nodes.join(comp.select(F.col("component").alias("id")).distinct(), "id").select(F.col("id").alias("component"), F.col("rep").alias("component_id"))
    roots = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    comp = comp.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    linked = comp.join(roots, ["component", "salt"]).select(F.col("node").alias("id"), "component_id")
    final = nodes.select("node", "id", "rep").join(linked, "id", "left")
    final = stash(final.select("node", F.coalesce("component_id", "rep").alias("component_id")), "final")
    some = rows.where("node is not null and doc_id is not null").join(final, "node").select("doc_id", "key", "n", "component_id")
    none = rows.where("node is null or doc_id is null").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"))
    out = some.unionByName(none)
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")


def _joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) when further links (a, b) are added: these are taken between
    components, so the second pass is over few."""
    known = comp.select(F.col("node").alias("a"), F.col("component").alias("x"))
    ends = more.join(known, "a", "left").join(known.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left")
    again = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), "a", "b")
    again = again.select(F.col("node").alias("component"), F.col("component").alias("least"))
    both = comp.join(again, "component", "full")
    # A component of the first pass that is joined to others has its own row among `again`, as its smallest node.
    return both.select(F.coalesce("node", "component").alias("node"), F.coalesce("least", "component").alias("component")).distinct()


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without all but one of each group of near copies: the one of the smallest
    id stays. Rows with null ids stay; of rows equal in id and text one stays. All columns of docs
    stay, whatever their names."""
    groups = stash(near_copies(docs.select("doc_id", "text"), k, num, den).select("doc_id", "key", "component_id"), "groups")
    id_, text_key = free_name(docs, "_id"), free_name(docs, "_key")
    key = [F.col("doc_id").cast("long") == F.col(id_), F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_key)]
    named = groups.select(F.col("doc_id").alias(id_), F.col("key").alias(text_key), "component_id")
    kept = docs.join(named.where(F.col(id_) != F.col("component_id")).select(id_, text_key).distinct(), key, "left_anti")
    repeated = named.where(F.col(id_).isNotNull()).groupBy(id_, text_key).count().where("count > 1").select(id_, text_key)
    repeated = stash(repeated, "repeated")
    if not repeated.limit(1).count():
        return kept
    again = kept.join(repeated, key, "left_semi")
    return kept.join(repeated, key, "left_anti").unionByName(again.dropDuplicates(["doc_id", "text"]))
