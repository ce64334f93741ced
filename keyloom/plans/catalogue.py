"""The engine's own queries over the driver tables, and the same in DuckDB SQL.

Each query runs an operator over a table seen as a key-value relation; keys and values are bytes
inside and come out as strings or hex."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import codec, hashing, layout
from keyloom.operators import batch, metrics, overlay
from keyloom.operators.bounds import excluded, included
from keyloom.operators.read import ReadView, View
from keyloom.plans.options import Options
from keyloom.plans.store import Store
from keyloom.session import scratch
from keyloom.sources.tables import as_entries, export_entries, json_entries
from keyloom.streaming import checkpoint, log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Key-value shapes of the tables, for DuckDB.
VIEWS = {
    "orders_kv": "SELECT printf('%010d', o_orderkey) AS k, concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority) AS v FROM orders",
    "customer_kv": "SELECT r_name AS b1, n_name AS b2, printf('%010d', c_custkey) AS k, c_mktsegment AS v FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "events_kv": "SELECT concat('u', printf('%06d', user_id), ':', printf('%010d', event_id)) AS k, event_type AS v FROM events",
    "documents_kv": "SELECT printf('%010d', doc_id) AS k, coalesce(text, '') AS v FROM documents",
    "event_ops": "SELECT event_id AS seq, CAST(event_id // 20 AS BIGINT) AS txid, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, "
    "printf('%06d', user_id) AS k, event_type AS v, (event_id // 20) % 7 <> 3 AS committed FROM events",
    "order_pages": "SELECT o_orderkey AS page_id FROM orders WHERE o_orderstatus = 'F'",
}


def query(sql: str | None = None):
    """Registers a query under its function's name; names of VIEWS in the SQL become CTEs."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            used = [f"{n} AS ({v})" for n, v in VIEWS.items() if n in sql]
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(used)} " if used else "") + sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pad(c: str, width: int = 10) -> Column:
    return F.lpad(F.col(c).cast("string"), width, "0")


def orders_kv(s, d) -> DataFrame:
    value = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return as_entries(table(s, d, "orders"), pad("o_orderkey"), value, ("orders",))


def orders_view(s, d) -> View:
    return View(orders_kv(s, d), (b"orders",))


def events_view(s, d) -> View:
    key = F.concat(F.lit("u"), pad("user_id", 6), F.lit(":"), pad("event_id"))
    return View(as_entries(table(s, d, "events"), key, F.col("event_type"), ("events",)), (b"events",))


def documents_kv(s, d) -> DataFrame:
    return as_entries(table(s, d, "documents"), pad("doc_id"), F.coalesce("text", F.lit("")))


def customer_paths(s, d) -> DataFrame:
    """path (array of binary), key, value of customers under region / nation."""
    nation = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows, 5 rows
    rows = table(s, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.array(F.col("r_name").cast("binary"), F.col("n_name").cast("binary"))
    return rows.select(path.alias("path"), pad("c_custkey").cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"))


def customer_kv(s, d) -> DataFrame:
    return customer_paths(s, d).select(codec.ns_column(F.col("path")).alias("ns"), "key", "value")


def event_ops(s, d) -> DataFrame:
    """Operations of transactions of 20 events; every seventh never commits."""
    txid = F.floor(F.col("event_id") / 20)
    return table(s, d, "events").select(
        F.col("event_id").alias("seq"), txid.alias("txid"), F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"),
        F.lit(b"").alias("ns"), pad("user_id", 6).cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"),
        (txid % 7 != 3).alias("committed"),
    )


def event_log(s, d) -> DataFrame:
    """The same as a log with begin and commit records: lsn 30 * txid + place."""
    ops = event_ops(s, d)
    base = F.col("txid") * 30
    moves = ops.select(
        (base + 1 + F.col("seq") % 20).alias("lsn"), F.when(F.col("op") == "put", "put").otherwise("delete").alias("rtype"),
        F.lit(None).cast("long").alias("txid"), "key", "value",
    )
    none = F.lit(None).cast("binary")
    begin = ops.select("txid").distinct().select(base.alias("lsn"), F.lit("begin").alias("rtype"), "txid", none.alias("key"), none.alias("value"))
    ends = ops.where("committed").select("txid").distinct()
    commit = ends.select((base + 25).alias("lsn"), F.lit("commit").alias("rtype"), "txid", none.alias("key"), none.alias("value"))
    return moves.unionByName(begin).unionByName(commit)


def text(df: DataFrame) -> DataFrame:
    """key and value as strings k and v."""
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


# ---------------------------------------------------------------- point access


@query("SELECT k, v FROM orders_kv WHERE k = '0000000042'")
def point_get(s, d):
    return text(orders_view(s, d).get_df("0000000042"))


def _probes(s, n: int, step: int, extra: tuple = ()) -> DataFrame:
    keys = s.range(n).select(F.lpad((F.col("id") * step).cast("string"), 10, "0").cast("binary").alias("key"))
    return keys.unionByName(s.createDataFrame([(e,) for e in extra], "key binary")) if extra else keys


@query("SELECT p.k, v IS NOT NULL AS found FROM (VALUES ('0000000000'), ('nothing')) p(k) LEFT JOIN orders_kv o ON o.k = p.k")
def point_get_missing_probe(s, d):
    got = orders_view(s, d).multi_get([b"0000000000", b"nothing"])
    return got.select(F.col("key").cast("string").alias("k"), "found")


@query("SELECT p.k, v FROM (SELECT printf('%010d', i * 7919) AS k FROM range(100) t(i)) p LEFT JOIN orders_kv o ON o.k = p.k")
def multi_get(s, d):
    return text(orders_view(s, d).multi_get(_probes(s, 100, 7919)))


@query("SELECT k FROM (SELECT printf('%010d', i * 997) AS k FROM range(200) t(i)) p WHERE k IN (SELECT k FROM orders_kv)")
def contains_keys(s, d):
    return orders_view(s, d).present(_probes(s, 200, 997)).select(F.col("key").cast("string").alias("k"))


@query("SELECT k FROM (SELECT printf('%010d', i * 997) AS k FROM range(200) t(i)) p WHERE k NOT IN (SELECT k FROM orders_kv)")
def missing_keys(s, d):
    return orders_view(s, d).missing(_probes(s, 200, 997)).select(F.col("key").cast("string").alias("k"))


# ---------------------------------------------------------------- scans and ranges


@query("SELECT count(*) AS n, CAST(sum(octet_length(encode(k)) + octet_length(encode(v))) AS BIGINT) AS bytes FROM orders_kv")
def full_scan_count(s, d):
    rows = orders_view(s, d).rows
    return rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"))


def _range(name: str, where: str, start=None, end=None):
    def run(s, d):
        return text(orders_view(s, d).range(start, end))

    run.__name__ = name
    query(f"SELECT k, v FROM orders_kv WHERE {where} ORDER BY k")(run)


_range("range_incl", "k >= '0000001000' AND k <= '0000002000'", included("0000001000"), included("0000002000"))
_range("range_half_open", "k >= '0000001000' AND k < '0000002000'", "0000001000", "0000002000")
_range("range_from", "k >= '0000000900'", "0000000900")
_range("range_to", "k < '0000000100'", None, "0000000100")
_range("range_to_incl", "k <= '0000000100'", None, included("0000000100"))
_range("range_excl_start", "k > '0000000100' AND k < '0000000200'", excluded("0000000100"), "0000000200")


@query("SELECT count(*) AS n FROM orders_kv WHERE k >= '0000002000' AND k < '0000001000'")
def range_inverted(s, d):
    return orders_view(s, d).range("0000002000", "0000001000").agg(F.count("*").alias("n"))


@query("SELECT k, v FROM events_kv WHERE starts_with(k, 'u00001')")
def prefix_scan(s, d):
    return text(events_view(s, d).prefix("u00001"))


@query("SELECT k, v FROM orders_kv ORDER BY k LIMIT 25")
def first_n(s, d):
    return text(orders_view(s, d).first(25))


@query("SELECT k, v FROM orders_kv ORDER BY k DESC LIMIT 25")
def last_n(s, d):
    return text(orders_view(s, d).first(25, reverse=True))


@query(
    "SELECT lo, count(*) AS n FROM (SELECT printf('%010d', i * 100) AS lo, printf('%010d', i * 100 + 50) AS hi FROM range(20) t(i)) r "
    "JOIN orders_kv ON k >= lo AND k < hi GROUP BY lo"
)
def multi_range_counts(s, d):
    lo = F.lpad((F.col("id") * 100).cast("string"), 10, "0").cast("binary")
    hi = F.lpad((F.col("id") * 100 + 50).cast("string"), 10, "0").cast("binary")
    ranges = F.broadcast(s.range(20).select(lo.alias("lo"), hi.alias("hi")))  # 20 rows
    found = orders_view(s, d).multi_range(ranges)
    return found.groupBy(F.col("lo").cast("string").alias("lo")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- buckets


@query("SELECT k, v FROM customer_kv WHERE b1 = 'ASIA' AND b2 = 'NATION_7' ORDER BY k")
def bucket_scan(s, d):
    return text(View(customer_kv(s, d), (b"ASIA", b"NATION_7")).scan())


@query("SELECT k, v FROM customer_kv WHERE b1 = 'EUROPE' AND b2 = 'NATION_3' AND k >= '0000000200' AND k < '0000000900' ORDER BY k")
def bucket_range(s, d):
    return text(View(customer_kv(s, d), (b"EUROPE", b"NATION_3")).range("0000000200", "0000000900"))


def names(s, rows: list[tuple], schema: str) -> DataFrame:
    """A listing of the catalogue (not of data) as a table."""
    return s.createDataFrame(rows, schema)


def customer_view(s, d) -> ReadView:
    """customer_kv with its catalogue: a bucket for each region that has a nation, and below it those."""
    nation = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows, 5 rows
    paths = {(r["r_name"].encode(), r["n_name"].encode()) for r in nation.select("r_name", "n_name").collect()}
    return ReadView(customer_kv(s, d), frozenset(paths | {p[:1] for p in paths}))


@query(
    "SELECT r_name AS parent, n_name AS name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY octet_length(encode(n_name)), n_name) AS INT) AS place "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def list_nested_children(s, d):
    view = customer_view(s, d)
    rows = [(p.decode(), c.decode(), i + 1) for p in view.list_buckets() for i, c in enumerate(view.list_nested_buckets(p))]
    return names(s, rows, "parent string, name string, place int")


@query("SELECT r_name AS name, CAST(row_number() OVER (ORDER BY octet_length(encode(r_name)), r_name) AS INT) AS place FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def list_buckets_len_order(s, d):
    return names(s, [(n.decode(), i + 1) for i, n in enumerate(customer_view(s, d).list_buckets())], "name string, place int")


@query(
    "SELECT p.b1, p.b2, (b1, b2) IN (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) AS found "
    "FROM (SELECT r_name AS b1, n_name AS b2 FROM region, nation) p"
)
def bucket_exists_grid(s, d):
    view = customer_view(s, d)
    nations = sorted({p[1] for p in view.buckets if len(p) == 2})
    regions = [r["r_name"].encode() for r in table(s, d, "region").collect()]  # 5 rows
    return names(s, [(r.decode(), n.decode(), view.nested_bucket_exists(r, n)) for r in regions for n in nations], "b1 string, b2 string, found boolean")


@query(
    "SELECT lower('03' || '02' || lpad(to_hex(octet_length(encode(b1))), 2, '0') || hex(encode(b1)) || lpad(to_hex(octet_length(encode(b2))), 2, '0') "
    "|| hex(encode(b2)) || hex(encode(k))) AS internal, v FROM customer_kv UNION ALL "
    "SELECT lower('00' || lpad(to_hex(octet_length(encode(r_name))), 2, '0') || hex(encode(r_name))), '' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) "
    "UNION ALL SELECT lower('02' || '02' || lpad(to_hex(octet_length(encode(r_name))), 2, '0') || hex(encode(r_name)) || lpad(to_hex(octet_length(encode(n_name))), 2, '0') "
    "|| hex(encode(n_name))), '' FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def iterate_all(s, d):
    return customer_view(s, d).iter().select(F.lower(F.hex("key")).alias("internal"), F.col("value").cast("string").alias("v"))


@query("SELECT b1, b2, count(*) AS n FROM customer_kv GROUP BY ALL")
def namespace_counts(s, d):
    ns = customer_paths(s, d).groupBy("path").agg(F.count("*").alias("n"))
    return ns.select(F.col("path")[0].cast("string").alias("b1"), F.col("path")[1].cast("string").alias("b2"), "n")


@query(
    "SELECT lower('03' || '02' || lpad(to_hex(octet_length(encode(b1))), 2, '0') || hex(encode(b1)) || lpad(to_hex(octet_length(encode(b2))), 2, '0') "
    "|| hex(encode(b2)) || hex(encode(k))) AS internal FROM customer_kv"
)
def encode_internal_key(s, d):
    rows = customer_paths(s, d)
    return rows.select(F.lower(F.hex(codec.internal_key_column(F.col("path"), F.col("key")))).alias("internal"))


@query("SELECT k FROM customer_kv WHERE b1 = 'ASIA' AND b2 = 'NATION_2'")
def strip_internal_key(s, d):
    internal = customer_paths(s, d).select(codec.internal_key_column(F.col("path"), F.col("key")).alias("i"))
    own = codec.user_key_column((b"ASIA", b"NATION_2"), F.col("i"))
    return internal.select(own.cast("string").alias("k")).where("k is not null")


# ---------------------------------------------------------------- metrics


@query(
    "SELECT count(*) AS keys_scanned, CAST(sum(octet_length(encode(k)) + octet_length(encode(v))) AS BIGINT) AS bytes_read, "
    "sum(octet_length(encode(k)) + octet_length(encode(v))) / CAST(count(*) AS DOUBLE) AS avg_bytes_per_key FROM events_kv"
)
def scan_metrics(s, d):
    return metrics.scan_metrics(events_view(s, d).rows)


# ---------------------------------------------------------------- writes


_LAST = "SELECT k, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY txid DESC, seq DESC) AS r FROM event_ops{}) WHERE r = 1"


@query(f"SELECT k, v FROM ({_LAST.format('')}) WHERE op = 'put'")
def bulk_upsert_last_wins(s, d):
    return text(overlay.collapse(event_ops(s, d)).where("op = 'put'"))


@query("SELECT k, v FROM orders_kv WHERE k NOT IN (SELECT printf('%010d', o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def bulk_delete(s, d):
    gone = table(s, d, "orders").where("o_orderstatus = 'F'")
    keys = as_entries(gone, pad("o_orderkey"), F.lit(""), ("orders",)).withColumn("op", F.lit("del"))
    return text(overlay.apply_ops(orders_kv(s, d), keys))


@query(
    f"SELECT k, v FROM (SELECT printf('%06d', c_custkey) AS k, c_mktsegment AS v FROM customer) WHERE k NOT IN (SELECT k FROM event_ops) "
    f"UNION ALL SELECT k, v FROM ({_LAST.format('')}) WHERE op = 'put'"
)
def overlay_read(s, d):
    base = as_entries(table(s, d, "customer"), pad("c_custkey", 6), F.col("c_mktsegment"))
    return text(overlay.apply_ops(base, overlay.collapse(event_ops(s, d))))


@query(
    "SELECT k, CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN 'updated' ELSE v END AS v FROM orders_kv WHERE CAST(k AS BIGINT) % 5 <> 0"
)
def interleaved_ops(s, d):
    base = orders_kv(s, d)
    id = F.col("key").cast("string").cast("long")
    puts = base.where(id % 2 == 0).select("ns", "key", F.lit(b"updated").alias("value"), F.lit("put").alias("op"), F.lit(0).alias("txid"), F.lit(0).alias("seq"))
    dels = base.where(id % 5 == 0).select("ns", "key", F.lit(None).cast("binary").alias("value"), F.lit("del").alias("op"), F.lit(0).alias("txid"), F.lit(1).alias("seq"))
    return text(overlay.apply_ops(base, overlay.collapse(puts.unionByName(dels))))


@query(
    "SELECT count(*) FILTER (WHERE hit) AS updates, count(*) FILTER (WHERE NOT hit) AS inserts FROM (SELECT DISTINCT k, "
    "k IN (SELECT printf('%06d', c_custkey) FROM customer) AS hit FROM event_ops WHERE op = 'put')"
)
def new_vs_updated_counts(s, d):
    base = as_entries(table(s, d, "customer"), pad("c_custkey", 6), F.lit(""))
    puts = event_ops(s, d).where("op = 'put'").select("ns", "key").distinct()
    hit = puts.join(base.select("ns", "key").withColumn("hit", F.lit(1)), ["ns", "key"], "left")
    return hit.agg(F.count("hit").alias("updates"), F.count_if(F.col("hit").isNull()).alias("inserts"))


@query("SELECT count(*) > 0 AS has_updates FROM event_ops WHERE op = 'put' AND k IN (SELECT printf('%06d', c_custkey) FROM customer)")
def update_detection(s, d):
    base = as_entries(table(s, d, "customer"), pad("c_custkey", 6), F.lit(""))
    one = overlay.updates(base, event_ops(s, d).where("op = 'put'")).limit(1)
    return one.agg((F.count("*") > 0).alias("has_updates"))


@query("SELECT b1, count(*) AS n FROM customer_kv WHERE b1 <> 'AFRICA' GROUP BY 1")
def drop_bucket_cascade(s, d):
    kept = overlay.without_below(customer_kv(s, d), codec.encode_path(["AFRICA"]))
    name = F.substring("ns", 2, 1 << 30).cast("string")
    names = {n: codec.encode_path([n]) for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    label = F.coalesce(*[F.when(F.startswith("ns", F.lit(v)), F.lit(k)) for k, v in names.items()], name)
    return kept.groupBy(label.alias("b1")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer_kv WHERE NOT (b1 = 'ASIA' AND b2 = 'NATION_12')")
def drop_nested_cascade(s, d):
    return overlay.without_below(customer_kv(s, d), codec.encode_path(["ASIA", "NATION_12"])).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- logs and snapshots


@query(f"SELECT k, v FROM ({_LAST.format(' WHERE committed')}) WHERE op = 'put'")
def wal_recover_committed(s, d):
    return text(log.recover(event_log(s, d)).where("op = 'put'"))


@query("SELECT txid, count(*) AS lost FROM event_ops WHERE NOT committed GROUP BY 1")
def wal_uncommitted_lost(s, d):
    all_ops = log.attribute(event_log(s, d)).where("rtype in ('put', 'delete')").select(F.col("owner").alias("txid"))
    good = log.committed(event_log(s, d)).select("txid").distinct()
    return all_ops.join(good, "txid", "left_anti").groupBy("txid").agg(F.count("*").alias("lost"))


@query(
    "SELECT txid, n >= 20 AND bytes >= 250 OR bytes >= 290 AS due FROM (SELECT txid, count(*) AS n, "
    "sum(octet_length(encode(k)) + octet_length(encode(v))) AS bytes FROM event_ops GROUP BY 1)"
)
def checkpoint_due(s, d):
    per_tx = event_ops(s, d).groupBy("txid").agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes"))
    never = checkpoint.CheckpointConfig(interval_s=1e12, wal_threshold=290, min_records=1 << 40)
    both = checkpoint.CheckpointConfig(interval_s=1e12, wal_threshold=1 << 40, min_records=20)
    zero = F.lit(0.0)
    due = checkpoint.is_due(zero, F.col("bytes"), F.col("n"), never) | (checkpoint.is_due(zero, F.lit(0), F.col("n"), both) & (F.col("bytes") >= 250))
    return per_tx.select("txid", due.alias("due"))


@query(
    "SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS commits, sum(n) / CAST(count(*) AS DOUBLE) AS avg_batch FROM "
    "(SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY txid) - 1) // 100 AS g FROM (SELECT DISTINCT txid FROM event_ops WHERE committed)) GROUP BY g)"
)
def group_commit_batches(s, d):
    commits = event_ops(s, d).where("committed").select(F.col("txid").alias("lsn")).distinct()
    sizes = batch.group_commits(commits).groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("batches"), F.sum("n").alias("commits"), (F.sum("n") / F.count("*")).alias("avg_batch"))


# ---------------------------------------------------------------- batches


@query(
    "SELECT min(page_id) AS start, count(*) AS pages, max(page_id) AS \"end\" FROM (SELECT page_id, page_id - row_number() OVER (ORDER BY page_id) AS g "
    "FROM order_pages) GROUP BY g"
)
def contiguous_ranges(s, d):
    pages = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"))
    return batch.contiguous_ranges(pages, block=1024)


@query("SELECT user_id AS page_id, arg_max(event_type, event_id) AS data FROM events GROUP BY 1")
def page_coalesce_last_write(s, d):
    writes = table(s, d, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("data"))
    return batch.coalesce_pages(writes)


@query(
    "SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS total, min(n) AS smallest, max(n) AS largest, max(n) / CAST(min(n) AS DOUBLE) AS imbalance "
    "FROM (SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY page_id) - 1) // CAST(ceil((SELECT count(*) FROM order_pages) / 8.0) AS BIGINT) AS p "
    "FROM order_pages) GROUP BY p)"
)
def partition_batch_stats(s, d):
    pages = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"))
    return batch.partition_stats(batch.partition_runs(pages, 8))


@query(
    "SELECT count(*) AS entries, count(*) FILTER (WHERE n > 16384) AS overflow_entries, "
    "CAST(sum(4 + 10 + CASE WHEN n > 16384 THEN 16 ELSE 4 + n END) AS BIGINT) AS total_bytes FROM (SELECT octet_length(encode(v)) AS n FROM documents_kv)"
)
def prepare_entries_stats(s, d):
    return batch.entry_stats(documents_kv(s, d))


@query("SELECT k, CAST(octet_length(encode(v)) AS INT) AS bytes FROM documents_kv WHERE octet_length(encode(v)) > 16384")
def overflow_values(s, d):
    big = documents_kv(s, d).where(layout.is_overflow(F.col("value")))
    return big.select(F.col("key").cast("string").alias("k"), F.octet_length("value").alias("bytes"))


@query(
    "SELECT k, CAST(CASE WHEN n = 0 THEN 0 ELSE n + 12 END AS BIGINT) AS direct_bytes, CAST(ceil(n / 32744.0) * 32768 AS BIGINT) AS chain_bytes "
    "FROM (SELECT k, octet_length(encode(v)) AS n FROM documents_kv)"
)
def overflow_page_math(s, d):
    n = F.octet_length("value")
    return documents_kv(s, d).select(F.col("key").cast("string").alias("k"), layout.direct_size(n).alias("direct_bytes"), layout.chain_size(n).alias("chain_bytes"))


@query(
    "SELECT event_id, (user_id << 32) | event_id AS lsn, ((user_id << 32) | event_id) >> 32 AS segment, ((user_id << 32) | event_id) & 4294967295 AS off FROM events"
)
def lsn_pack_unpack(s, d):
    rows = table(s, d, "events").select("event_id", layout.lsn(F.col("user_id"), F.col("event_id")).alias("lsn"))
    return rows.withColumns({"segment": layout.lsn_segment(F.col("lsn")), "off": layout.lsn_offset(F.col("lsn"))})


# ---------------------------------------------------------------- hashes, filters, streams


@query(f"SELECT k, {hashing.crc_sql(hashing.bytes_sql('v'))} AS crc FROM documents_kv, {hashing.CRC_STEPS_SQL} c")
def checksum_crc32(s, d):
    return documents_kv(s, d).select(F.col("key").cast("string").alias("k"), hashing.crc(F.col("value")).alias("crc"))


@query(f"SELECT k, {hashing.fnv1a_sql(hashing.bytes_sql('k'))} AS fnv FROM orders_kv")
def fnv1a_hash(s, d):
    return orders_kv(s, d).select(F.col("key").cast("string").alias("k"), hashing.fnv1a(F.col("key")).alias("fnv"))


@query("SELECT 0 AS false_negatives, count(*) AS n FROM orders")
def bloom_no_false_negative(s, d):
    keys = orders_kv(s, d)
    bloom = hashing.bloom_of(keys, "key", keys.count())
    seen = keys.select(hashing.may_contain(bloom, F.col("key")).alias("hit"))
    return seen.agg(F.count_if(~F.col("hit")).cast("int").alias("false_negatives"), F.count("*").alias("n"))


@query(f"SELECT k, v FROM ({_LAST.format(' WHERE committed')}) WHERE op = 'put'")
def stream_follow(s, d):
    """Committed deltas written as files, followed as a stream, each batch merged into what came before."""
    root = scratch(s, "follow")
    delta = ["txid", "seq", "op", "ns", "key", "value"]
    event_ops(s, d).where("committed").select(*delta).withColumn("part", F.col("txid") % 2).write.partitionBy("part").parquet(f"{root}/delta")
    states: list[str] = []

    def merge(batch: DataFrame, id: int) -> None:
        if states:  # the state keeps deletes and what orders them, so batches may hold files in any order
            batch = overlay.collapse(batch.unionByName(s.read.parquet(states[-1])), keep=("txid", "seq", "op", "value"))
        batch.write.mode("overwrite").parquet(f"{root}/state/{id}")
        states.append(f"{root}/state/{id}")

    log.follow(s, f"{root}/delta", merge, f"{root}/check", True, 2).awaitTermination()
    return text(s.read.parquet(states[-1]).where("op = 'put'"))


# ---------------------------------------------------------------- the store

#: Every store query makes a store of its own from the tables, and reads it after what its name says.


def ordered(rows: DataFrame) -> DataFrame:
    """An operation table as batch_put takes it: key, value and the order of repeated keys."""
    return rows.select("key", "value", F.col("seq"))


def event_store(s, d, name: str, cuts: tuple[int, ...], options: Options | None = None) -> Store:
    """A store of the events' operations: a commit for each run of transactions between cuts. Batches
    of puts and deletes of one commit are taken in turn, so each holds the last operations of its run."""
    store = Store.open(s, scratch(s, name), options)
    ops = event_ops(s, d)
    for lo, hi in zip((-1, *cuts), (*cuts, 1 << 60)):
        last = overlay.collapse(ops.where((F.col("txid") > lo) & (F.col("txid") <= hi)))
        with store.write_tx() as tx:
            tx.batch_put(last.where("op = 'put'"))
            tx.batch_delete(last.where("op = 'del'"))
            tx.commit()
    return store


_ALL = f"SELECT k, v FROM ({_LAST.format('')}) WHERE op = 'put'"


@query("SELECT k, v FROM orders_kv")
def store_commit_reopen(s, d):
    root = scratch(s, "reopen")
    with Store.open(s, root).write_tx() as tx:
        tx.create_bucket("orders")
        tx.bucket_batch_put(["orders"], orders_view(s, d).rows)
        tx.commit()
    return text(Store.open(s, root).read_tx().bucket("orders").scan())


@query("SELECT k, CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN 'updated' ELSE v END AS v FROM orders_kv WHERE CAST(k AS BIGINT) % 5 <> 0")
def store_read_your_writes(s, d):
    """What an open transaction sees, before any commit of it."""
    rows, id = orders_view(s, d).rows, F.col("key").cast("string").cast("long")
    store = Store.open(s, scratch(s, "own"))
    with store.write_tx() as tx:
        tx.create_bucket("orders")
        tx.bucket_batch_put(["orders"], rows)
        tx.commit()
    tx = store.write_tx()
    tx.bucket_batch_put(["orders"], rows.where(id % 2 == 0).withColumn("value", F.lit(b"updated")))
    tx.bucket_batch_delete(["orders"], rows.where(id % 5 == 0).select("key"))
    view = tx.bucket("orders")
    tx.rollback()
    return text(view.scan())


@query("SELECT count(*) AS n FROM orders_kv WHERE k < '0000000050'")
def store_rollback(s, d):
    store = Store.open(s, scratch(s, "rollback"))
    with store.write_tx() as tx:
        tx.batch_put(orders_view(s, d).range("0000000000", "0000000050"))
        tx.commit()
    with store.write_tx() as tx:
        tx.batch_put(orders_view(s, d).rows)
        tx.create_bucket("gone")
    return store.read_tx().kv.agg(F.count("*").alias("n"))


@query(f"SELECT k, v FROM ({_LAST.format(' WHERE txid <= 100')}) WHERE op = 'put'")
def snapshot_as_of(s, d):
    """A snapshot read after later commits, a checkpoint and a vacuum."""
    store = Store.open(s, scratch(s, "snapshot"))
    last = overlay.collapse(event_ops(s, d).where("txid <= 100"))
    with store.write_tx() as tx:
        tx.batch_put(last.where("op = 'put'"))
        tx.commit()
    held = store.create_snapshot()
    with store.write_tx() as tx:
        tx.batch_delete(last.select("key"))
        tx.put("later", "x")
        tx.commit()
    store.checkpoint()
    store.vacuum(min_age_s=-1)
    return text(store.get_snapshot(held).scan())


@query(f"SELECT k, v FROM ({_LAST.format(' WHERE txid <= 200')}) WHERE op = 'put'")
def store_time_travel(s, d):
    return text(event_store(s, d, "travel", (100, 200, 300)).as_of(2).scan())


@query(_ALL)
def store_commits(s, d):
    return text(event_store(s, d, "commits", (50, 150, 250, 350)).read_tx().scan())


@query(_ALL)
def store_checkpoint_vacuum(s, d):
    store = event_store(s, d, "checkpoint", (100, 300))
    store.checkpoint()
    store.vacuum(min_age_s=-1)
    return text(Store.open(s, store.path).read_tx().scan())


@query(_ALL)
def store_log_replay(s, d):
    """Commits that are in the log alone, replayed when the store is opened."""
    store = event_store(s, d, "replay", (200, 400), Options(wal_enabled=True, wal_segment_size=1 << 30))
    return text(Store.open(s, store.path).read_tx().scan())


@query("SELECT k, v FROM orders_kv WHERE k < '0000000300' UNION ALL SELECT 'small', 'x'")
def store_log_of_small_commits(s, d):
    """Transactions of single rows, shared by threads and written as segments of the log."""
    root = scratch(s, "small")
    store = Store.open(s, root, Options(wal_enabled=True))
    rows = [(bytes(r["key"]), bytes(r["value"])) for r in orders_view(s, d).range(None, "0000000300").collect()]  # 300 rows
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: store.update(lambda tx: tx.batch_put(rows[i::10])), range(10)))
    with store.write_tx() as tx:
        tx.put("small", "x")
        tx.commit()
    return text(Store.open(s, root).read_tx().scan())


def customer_store(s, d, name: str) -> Store:
    store, rows = Store.open(s, scratch(s, name)), customer_paths(s, d)
    with store.write_tx() as tx:
        for path in customer_view(s, d).paths():
            tx.create_nested_bucket_at_path(path[:-1], path[-1]) if len(path) > 1 else tx.create_bucket(path[0])
        for b1, b2 in (("ASIA", "NATION_2"), ("ASIA", "NATION_7"), ("EUROPE", "NATION_3")):
            own = rows.where((F.col("path")[0] == F.lit(b1.encode())) & (F.col("path")[1] == F.lit(b2.encode())))
            tx.bucket_batch_put([b1, b2], own.select("key", "value"))
        tx.commit()
    return store


_CUSTOMERS = "SELECT b1, b2, k, v FROM customer_kv WHERE (b1, b2) IN (('ASIA', 'NATION_2'), ('ASIA', 'NATION_7'), ('EUROPE', 'NATION_3'))"


@query(f"SELECT b1, b2, k, v FROM ({_CUSTOMERS}) WHERE b1 <> 'ASIA' UNION ALL SELECT 'ASIA', 'NATION_2', 'again', '1'")
def store_bucket_life(s, d):
    """A bucket is dropped with all below it, made again and filled again."""
    store = customer_store(s, d, "life")
    with store.write_tx() as tx:
        tx.delete_bucket("ASIA")
        tx.create_bucket("ASIA")
        tx.create_nested_bucket("ASIA", "NATION_2")
        tx.nested_bucket_put("ASIA", "NATION_2", "again", "1")
        tx.commit()
    view = Store.open(s, store.path).read_tx()
    parts = [(p, view.nested_bucket_at_path(p).rows) for p in view.paths() if len(p) > 1]
    out = [text(rows).select(F.lit(p[0].decode()).alias("b1"), F.lit(p[1].decode()).alias("b2"), "k", "v") for p, rows in parts]
    return reduce(DataFrame.unionByName, out)


@query(f"SELECT k, v FROM ({_CUSTOMERS}) WHERE b2 <> 'NATION_7'")
def store_nested_drop(s, d):
    store = customer_store(s, d, "nested")
    with store.write_tx() as tx:
        tx.delete_nested_bucket("ASIA", "NATION_7")
        tx.commit()
    return text(store.read_tx().kv)


@query("SELECT depth, count(*) AS n FROM (SELECT 1 AS depth FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 2 FROM nation) GROUP BY 1")
def store_sql_views(s, d):
    customer_store(s, d, "views").register_views("keyloom_")
    return s.sql("SELECT depth, count(*) AS n FROM keyloom_buckets GROUP BY depth")


@query(
    "SELECT count(*) FILTER (WHERE hit) AS updates, count(*) FILTER (WHERE NOT hit) AS inserts FROM (SELECT DISTINCT k, "
    "k IN (SELECT printf('%06d', c_custkey) FROM customer) AS hit FROM event_ops WHERE op = 'put')"
)
def store_insert_bulk(s, d):
    store = Store.open(s, scratch(s, "bulk"))
    puts = event_ops(s, d).where("op = 'put'")
    with store.write_tx() as tx:
        base = as_entries(table(s, d, "customer"), pad("c_custkey", 6), F.lit(""))
        old = tx.insert_bulk(base.select("key", "value"))
        new = tx.insert_bulk(ordered(puts), seq="seq")
        after = tx.view().kv.agg((F.count("*") - old).alias("inserts"))
        tx.commit()
    return after.select((F.lit(puts.select("key").distinct().count()) - F.lit(new)).cast("long").alias("updates"), "inserts")


@query("SELECT true AS present, false AS absent, count(*) AS n FROM orders_kv")
def store_may_contain_key(s, d):
    view = ReadView(orders_kv(s, d), frozenset({(b"orders",)}))
    present, absent = view.may_contain_key("0000000000", [b"orders"]), view.may_contain_key("0000000000")
    return view.kv.agg(F.lit(present).alias("present"), F.lit(absent).alias("absent"), F.count("*").alias("n"))


# ---------------------------------------------------------------- shapes of batches


@query(
    "SELECT user_id, event_id, CAST(floor((sum(octet_length(encode(props))) OVER w - octet_length(encode(props))) / 4096) AS BIGINT) AS flush "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
)
def flush_points(s, d):
    rows = table(s, d, "events").select("user_id", "event_id", "props")
    return batch.flush_points(rows, "user_id", "event_id", F.octet_length("props"), 4096).select("user_id", "event_id", "flush")


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS data FROM events GROUP BY 1")
def sequential_bytes(s, d):
    writes = table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").cast("binary").alias("data"))
    return batch.sequential_bytes(writes, "user_id").select("user_id", F.col("data").cast("string").alias("data"))


@query("SELECT min(page_id) * 32768 AS byte_offset, count(*) AS pages FROM (SELECT page_id, page_id - row_number() OVER (ORDER BY page_id) AS g FROM order_pages) GROUP BY g")
def range_offsets(s, d):
    pages = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"))
    runs = batch.contiguous_ranges(pages, block=1024)
    return runs.select(batch.range_offset(F.col("start"), 32768).alias("byte_offset"), "pages")


@query("SELECT count(*) AS pages, CAST(sum(octet_length(encode(event_type))) AS BIGINT) AS bytes FROM (SELECT arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)")
def batch_total_size(s, d):
    writes = table(s, d, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), F.col("event_type").cast("binary").alias("data"))
    return batch.total_size(batch.coalesce_pages(writes))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders")
def chunks(s, d):
    return batch.chunk(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT k, v FROM orders_kv")
def export_import(s, d):
    """Entries written as JSON in key order and read back."""
    path = scratch(s, "export")
    export_entries(orders_kv(s, d), path, "json")
    back = json_entries(s, path, "key", "value")
    return back.select(*[F.unhex(F.col(c).cast("string")).cast("string").alias(c[0]) for c in ("key", "value")])
