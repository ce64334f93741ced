import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom import errors
from keyloom.functions import codec
from keyloom.functions.hashing import BloomFilter, fnv1a, fnv1a_many
from keyloom.operators import batch
from keyloom.operators.bounds import Bound, excluded, included
from keyloom.operators.metrics import ScanMetrics
from keyloom.operators.read import View
from keyloom.sources.wal import Record, RecordType, WalWriter, decode, read_wal
from keyloom.streaming import log
from keyloom.streaming.checkpoint import CheckpointConfig, CheckpointInfo, CheckpointPolicy, perform_checkpoint
from keyloom.streaming.group_commit import GroupCommit, GroupCommitConfig

KEYS = [b"", b"\x00", b"\x00\x01", b"a", b"ab", b"b", b"\x7f", b"\x80", b"\xff", b"\xff\xff"]


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_successor_bounds_prefix(prefix, key):
    end = codec.successor(prefix)
    assert (key >= prefix and (end is None or key < end)) == key.startswith(prefix)


@given(st.lists(st.binary(min_size=1, max_size=5), min_size=1, max_size=4))
def test_paths_round_trip(path):
    assert codec.decode_path(codec.encode_path(path)) == tuple(path)
    assert codec.user_key(path, codec.internal_key(path, b"k")) == b"k"


def test_ranges_match_python(spark):
    view = View(spark.createDataFrame([(b"", k, k) for k in KEYS], "ns binary, key binary, value binary"))
    bounds = [None, included(b"a"), excluded(b"a"), included(b""), excluded(b"\xff"), included(b"\xff\xff"), b"ab"]
    for lo in bounds:
        for hi in bounds:
            a = lo if isinstance(lo, Bound) or lo is None else included(lo)
            b = hi if isinstance(hi, Bound) or hi is None else excluded(hi)
            want = [
                k for k in sorted(KEYS)
                if (a is None or k > a.key or a.included and k == a.key) and (b is None or k < b.key or b.included and k == b.key)
            ]
            assert [bytes(r["key"]) for r in view.range(lo, hi).collect()] == want
    for p in KEYS:
        assert [bytes(r["key"]) for r in view.prefix(p).collect()] == [k for k in sorted(KEYS) if k.startswith(p)]
    assert [bytes(r["key"]) for r in view.first(2, reverse=True).collect()] == [b"\xff\xff", b"\xff"]
    got = {bytes(r["key"]): r["found"] for r in view.multi_get([b"", b"zz"]).collect()}
    assert got == {b"": True, b"zz": False}


def test_observed_scan(spark):
    view = View(spark.createDataFrame([(b"", b"k%d" % i, b"vv") for i in range(50)], "ns binary, key binary, value binary"))
    scan = view.scan_observed()
    scan.df.collect()
    m = scan.metrics()
    assert m.keys_scanned == 50 and m.bytes_read == 10 * 2 + 40 * 3 + 100 and m.cache_hit_ratio == -1.0
    assert ScanMetrics(0, 0, 0.0).avg_bytes_per_key() == 0.0


def test_fnv_and_bloom(spark):
    def slow(data, seed=0):
        h = 0xCBF29CE484222325 ^ seed
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    values = [b"", b"a", b"foobar", bytes(range(256))]
    assert fnv1a_many(values, 7).tolist() == [slow(v, 7) for v in values]
    got = spark.createDataFrame([(v,) for v in values], "v binary").select(fnv1a(F.col("v")).alias("h")).collect()
    assert [r["h"] for r in got] == [f"{slow(v):016x}" for v in values]
    bloom = BloomFilter(1000, 0.01)
    keys = [b"key%d" % i for i in range(1000)]
    bloom.insert(*keys)
    copy = BloomFilter.from_bytes(bloom.to_bytes())
    assert copy.may_contain(*keys).all() and copy.may_contain(*[b"no%d" % i for i in range(2000)]).mean() < 0.05
    assert BloomFilter.from_bytes(b"short") is None


@settings(max_examples=30)
@given(st.binary(max_size=50), st.binary(max_size=50), st.integers(0, 2**63))
def test_wal_codec(key, value, number):
    for r in (Record(RecordType.PUT, key, value), Record(RecordType.DELETE, key), Record(RecordType.COMMIT, number=number)):
        raw = r.encode()
        assert decode(raw) == (r, len(raw))
        with pytest.raises((errors.WalRecordInvalid, errors.WalCorrupted)):
            decode(raw[:-1])
        with pytest.raises((errors.WalRecordInvalid, errors.WalCorrupted)):
            decode(raw[:5] + bytes([raw[5] ^ 1]) + raw[6:])


def test_wal_recovery(spark, tmp_path):
    wal = WalWriter(str(tmp_path), segment_size=200, sync="batched")
    put, begin, commit, abort = (lambda t: lambda *a, **k: wal.append(Record(t, *a, **k)))(RecordType.PUT), RecordType.BEGIN, RecordType.COMMIT, RecordType.ABORT
    put(b"orphan", b"0")
    wal.append(Record(begin, number=1))
    put(b"k1", b"a")
    put(b"k2", b"b")
    wal.append(Record(commit, number=1))
    put(b"late", b"x")
    wal.append(Record(begin, number=2))
    put(b"k3", b"lost")
    wal.append(Record(begin, number=3))
    wal.append(Record(RecordType.DELETE, b"k1"))
    put(b"k4", b"d")
    wal.append(Record(commit, number=3))
    wal.append(Record(begin, number=4))
    put(b"k2", b"undone")
    wal.append(Record(abort, number=4))
    lsn = wal.current_lsn()
    wal.close()
    assert len(wal.segments()) > 1
    got = {bytes(r["key"]): (r["op"], r["value"] and bytes(r["value"])) for r in log.recover(read_wal(spark, f"file://{tmp_path}")).collect()}
    assert got == {b"k1": ("del", None), b"k2": ("put", b"b"), b"k4": ("put", b"d")}
    again = WalWriter(str(tmp_path), segment_size=200)
    assert again.current_lsn() == lsn
    with pytest.raises(errors.CheckpointFailed):
        perform_checkpoint(lsn, again, lambda: 1 / 0)
    assert len(again.segments()) > 1
    info = perform_checkpoint(lsn, again, lambda: 3, lambda: 9.0)
    assert len(again.segments()) == 1 and info == CheckpointInfo(lsn, 9, 3) == CheckpointInfo.from_bytes(info.to_bytes())
    assert CheckpointInfo.from_bytes(b"short") is None and CheckpointPolicy.restore(None, info, now=lambda: 10.0).should_checkpoint(0) is False
    assert CheckpointPolicy.restore(None, info, now=lambda: 1000.0).should_checkpoint(0) and CheckpointPolicy.restore(None, info).last_checkpoint_lsn() == lsn


def test_checkpoint_policy():
    clock = [0.0]
    p = CheckpointPolicy(CheckpointConfig(100, 1000, 10), now=lambda: clock[0])
    p.record_writes(1)
    clock[0] = 500.0
    assert not p.should_checkpoint(5000)  # before the first one only records count
    p.record_writes(9)
    assert p.should_checkpoint(0)
    p.record_checkpoint(CheckpointInfo(1, 0, 0), 5000)
    assert not p.should_checkpoint(5999) and p.should_checkpoint(6000)
    clock[0] = 600.0
    assert p.should_checkpoint(0)


def test_group_commit():
    seen = []
    g = GroupCommit(lambda items: seen.extend(items), GroupCommitConfig(0.01, 8))
    threads = [threading.Thread(target=g.commit, args=(i,)) for i in range(40)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(10)
    assert sorted(seen) == list(range(40)) and g.commit_count == 40 and g.avg_batch_size() >= 1
    bad = GroupCommit(lambda items: 1 / 0)
    with pytest.raises(errors.GroupCommitFailed):
        bad.commit(1)


def test_batches(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(500), 300))
    pages = spark.createDataFrame([(i,) for i in ids], "page_id long")
    runs, want = batch.contiguous_ranges(pages, block=16).collect(), []
    for i in ids:
        if want and want[-1][2] == i - 1:
            want[-1] = (want[-1][0], want[-1][1] + 1, i)
        else:
            want.append((i, 1, i))
    assert sorted(map(tuple, runs)) == want
    parts = {r["page_id"]: r["part"] for r in batch.partition_runs(pages, 7).collect()}
    assert [parts[i] for i in ids] == [n // 43 for n in range(300)]
    stats = batch.partition_stats(batch.partition_runs(pages, 7)).head()
    assert (stats["partitions"], stats["total"], stats["largest"]) == (7, 300, 43)
    assert batch.partition_stats(batch.partition_runs(pages.where("page_id < 0"), 7)).head()["imbalance"] == 1.0


@pytest.mark.parametrize("scale", [1, 2**13, 2**40])
def test_ranks_and_runs_of_ids_far_apart(spark, scale):
    rng = random.Random(scale)
    ids = sorted({base * scale + i for base in range(-3, 4) for i in rng.sample(range(70), 40)} | {-(2**62), 2**62 - 1, 2**62})
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    for digit in (2, 16):
        assert [tuple(r) for r in batch.ranked(rows, "id", digit).orderBy("id").select("id", "_rank").collect()] == [(x, i) for i, x in enumerate(ids)]
    want = []
    for i in ids:
        if want and want[-1][2] == i - 1:
            want[-1] = (want[-1][0], want[-1][1] + 1, i)
        else:
            want.append((i, 1, i))
    for block in (4, 1 << 16):
        assert sorted(map(tuple, batch.contiguous_ranges(rows, "id", block).collect())) == want
    sizes = batch.group_commits(rows, "id", 9).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [9] * (len(ids) // 9) + [len(ids) % 9] * (len(ids) % 9 > 0)
    assert not batch.ranked(rows.where("id is null"), "id").count() and not batch.contiguous_ranges(rows.where("id is null"), "id").count()


@pytest.mark.parametrize("block", [2, 7, 1 << 20])
def test_owners_whatever_the_blocks(spark, block):
    rng, rows, want, owner = random.Random(5), [], {}, None
    for at, lsn in enumerate(sorted(rng.sample(range(3000), 200))):
        kind = rng.choices(["put", "delete", "begin", "commit", "abort"], [8, 2, 1, 1, 1])[0]
        if kind in ("put", "delete"):
            want[lsn] = owner
        else:
            owner = (at, lsn) if kind == "begin" else None
        rows.append((lsn, kind, None if kind in ("put", "delete") else at, b"k", b"v"))
    found = log.attribute(spark.createDataFrame(rows, log.LOG).repartition(3), block).where("rtype in ('put', 'delete')").collect()
    assert {r["lsn"]: (r["owner"], r["incarnation"]) if r["owner"] is not None else None for r in found} == want
