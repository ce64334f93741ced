"""What the operators of this subpackage share: scratch tables in the cluster's shared folder,
vectorised tokenising of Arrow text columns, two-level prefix sums and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text whose intermediate arrays (about 60 bytes a byte) are in memory at once.
CHUNK = 1 << 20


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one if the
    master is a single local JVM. On a cluster without the setting this raises."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "file:///tmp/checkpoints/keyloom"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, so later stages neither
    recompute it nor depend on any executor, and joins know its size. Deleted when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes the files of a stashed table that nothing reads any more."""
    _delete(df.sparkSession, df._keyloom_path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now instead of after the JVM's next
    collection, which a driver with little garbage may put off for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int):
    """While it is open, the session's Arrow batches have at most so many rows: a batch is in memory on
    both sides of a worker's pipe, and Spark's 10 000 rows of long texts are many megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns the memory that this worker has freed to the system, which an idle worker else keeps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def aside(df: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """(df with other names for the columns that begin with the prefix, new names to old ones)."""
    names: dict[str, str] = {}
    for c in df.columns:
        if c.lower().startswith(prefix):
            names[c] = free_name(df, f"aside{prefix}{len(names)}")
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


# ---------------------------------------------------------------- words of Arrow text


def byte_class(chars: bytes, word_high: bool = True) -> np.ndarray:
    """A table of 256 booleans: chars, and with word_high all bytes of non-ASCII characters."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    table[128:] = word_high
    return table


#: All but the six ASCII white-space bytes.
NOT_SPACE = ~byte_class(b" \t\n\v\f\r", False)
#: ASCII letters and digits (lower case) and all non-ASCII characters.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (_P, _INV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """Yields (first row, row after the last, bytes, offsets) of a string column without nulls in
    runs of at most limit bytes; a longer text makes a run of its own (so a worker needs about 60
    bytes of memory for each byte of the longest text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a run of texts: start, end (byte positions), doc (row in the run), and the
    number of words before each row in `of`. Hashes are 64-bit and computed on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE):
        self.data, self.offsets = LOWER[data], offsets
        n = len(data)
        inside = word[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.of))
        self._sums = None

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first `most` bytes."""
        n = len(self.data)
        power, inverse = _powers(n + 1)
        if self._sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
            self._sums = sums
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        return mix((self._sums[end] - self._sums[self.start]) * inverse[self.start])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): those of row i are hashes[bounds[i]:bounds[i + 1]], with repeats. A text
    of 1 to k - 1 words has one, of its whole sequence; a text without words has none."""
    h, of = words.hashes(), words.of
    counts = np.diff(of)
    n_shingles = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.zeros(bounds[-1], np.uint64)
    if len(h) >= k:
        run = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            run = mix(run * np.uint64(0x2545F4914F6CDD1D) + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
        whole = words.doc[: len(run)] == words.doc[k - 1 :]
        out[np.repeat(counts >= k, n_shingles)] = run[whole]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for j, w in enumerate(h[of[i] : of[i + 1]]):
                x = mix(np.array([x * np.uint64(0x2545F4914F6CDD1D) + w + np.uint64(1009 * (j + 1))], np.uint64))[0]
        out[bounds[i]] = x
    return out, bounds


# ---------------------------------------------------------------- prefix sums


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over the rows before this one in its group, in the order
    (bucket, *order). A group is never in one task: sums of (group, bucket) are added up first,
    from partial aggregates, then each (group, bucket) is ordered alone. Choose the number of
    buckets so that one of them fits a task. Only built-in functions."""
    v, base, inner = (free_name(df, c) for c in ("_ps_value", "_ps_base", "_ps_inner"))
    df = df.withColumn(v, value)
    keys = [*group, bucket]
    names = {k: free_name(df, f"_ps_{k}") for k in keys}
    sums = df.groupBy(*keys).agg(F.sum(v).alias(base))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)).cast("long"))
    sums = sums.select(*[F.col(k).alias(names[k]) for k in keys], base)
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(inner, F.coalesce(F.sum(v).over(here), F.lit(0)).cast("long"))
    joined = df.join(sums, [F.col(k) == F.col(names[k]) for k in keys])
    return joined.withColumn(out, F.col(base) + F.col(inner)).drop(v, base, inner, *names.values())


# ---------------------------------------------------------------- connected components


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the links: the smallest id that links reach. Rounds of
    contraction: each node points at its smallest neighbour, pointers are followed twice, links
    between the targets remain. Each round is a few aggregates and equi-joins on written tables."""
    edges = stash(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges"
    )
    result = None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        parent = stash(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "parent")
        for _ in range(2):
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))
            parent = parent.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
        parent = stash(parent, "parent")
        left = parent.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = stash(
            edges.join(left, "a").join(right, "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .where("a < b").distinct(),
            "edges",
        )
        step = parent.select(F.col("node").alias("component"), F.col("to").alias("next"))
        result = parent.select("node", F.col("to").alias("component")) if result is None else (
            result.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        )
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stash(result, "components")
