"""The ten operators and the pipeline: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import html
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe, exact_topk, html_wrapper, learned_ann, licenses, mixing, ngram_join, quality, queries, sharding, toxicity
from keyloom.llm.shared import ALNUM, Words, components
from keyloom.llm.vectors import products, usable

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def odd_docs(spark):
    long = " ".join(random.Random(2).choices(WORDS, k=30_000))
    rows = [
        (1, "Alpha beta gamma delta", "en", "src1", 5), (1, "Alpha beta gamma delta", "en", "src1", 5), (2, None, None, None, None),
        (3, "", "de", "src2", 0), (None, "alpha beta", "en", "src1", 9), (4, "ALPHA  beta\tgamma\ndelta", None, "src1", 9),
        (5, "x" * 50_000, "fr", None, 50_000), (6, long, "fr", "other", len(long)), (7, " \n\t ", "fr", "src3", 4), (8, "a", "es", "src0", 1),
        (9, "éÉ 中<|endoftext|> MIT license", "es", "src0", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = ["score", "_score", "node", "n", "ids", "curve", "slot", "domain", "_id", "_key", "key", "_mix_tokens", "_mix_lang", "_ps_value", "_axis0", "_bucket", "_inner"]
    return rows, df.withColumns({c: F.lit(f"own {c}") for c in names})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def brute_components(rows, k, num, den):
    def shingle(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingle(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and den * len(x & y) >= num * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((rows[i][0], len(sets[i]), None if rows[i][0] is None else least[group[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_ngram_join_is_exact(spark, k, num, den):
    rng, rows = random.Random(k), []
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    passage = [f"p{i}" for i in range(30)]
    for i in range(260):
        w = list(bases[min(i % 20, 11)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(500)}"
        rows.append((i, " ".join(w + passage if i % 7 == 0 else w)))
    odd, extra = odd_docs(spark)
    rows += [((r[0] or 0) + 1000 if r[0] is not None else None, r[1]) for r in odd]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, num, den).drop("key").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, k, num, den)
    assert ngram_join.near_copies(extra, k, num, den).count() == len(odd)


def test_a_pair_is_formed_once_however_many_copies(spark, monkeypatch):
    """The map that skips unasked texts lets copies through by chance: here, with four marks, nearly all."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join([*words, "more"])]
    rows = [(i % 50, texts[i % 3]) if i < 150 else (i, f"t{i % 40} alone here {i % 40}") for i in range(300)]  # some ids are repeated
    monkeypatch.setattr(ngram_join, "MARKS", 4)
    monkeypatch.setattr(ngram_join, "MARK_PIECE", 4)
    written = {}

    def stash(df, name="t", plain=ngram_join.stash):
        out = plain(df, name)
        if name in ("products", "known"):
            written.setdefault(name, []).append(out.select(*out.columns[:2]).collect())
        return out

    monkeypatch.setattr(ngram_join, "stash", stash)
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90, 100).drop("key").collect()
    assert any(written["products"])
    for tables in written.values():
        for found in tables:
            assert len(set(found)) == len(found)
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90, 100)


def test_the_join_gets_short_batches_and_leaves_the_setting(spark, monkeypatch):
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], ngram_join.stash
    before = spark.conf.get(key)
    monkeypatch.setattr(ngram_join, "stash", lambda df, name="t": seen.append(int(spark.conf.get(key))) or plain(df, name))
    assert ngram_join.near_copies(empty(spark)).count() == 0
    assert seen and max(seen) <= 1000
    assert spark.conf.get(key) == before


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 700):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64))
        for m in (0, n // 2, n, n + 1):
            x, y = (np.sort(rng.choice(pool, size, replace=False)) for size in (n, m))
            found = ngram_join.odd_columns(ngram_join.parities(x), ngram_join.parities(y))
            assert found <= len(np.setxor1d(x, y))
        assert ngram_join.odd_columns(ngram_join.parities(x), ngram_join.parities(x)) == 0


def test_one_of_each_and_empty(spark):
    rows, extra = odd_docs(spark)
    found = ngram_join.one_of_each(extra).collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert {(r["_id"], r["_key"], r["key"], r["n"]) for r in found} == {("own _id", "own _key", "own key", "own n")}
    assert ngram_join.near_copies(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    group = {x: x for l in links for x in l}
    for _ in range(100):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {x: g for x, g in group.items() if x in got} and all(x in got or all(a == b for a, b in links if x in (a, b)) for x in group)


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    mine, rng = bpe.Bpe(queries.vocabulary()), random.Random(3)
    pool = [chr(c) for c in [*range(0x180), 0x85, 0xA0, 0x2028, 0x3000, 0x200B, 0x4E2D, 0x1F600, 0x301, 0x661]] + ["  ", "<|endoftext|>", "'s", "aaaa"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(1500)] + ["ab" * 20_000, ""]
    for t, ids in zip(texts, mine.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and mine.decode(ids) == library.decode(want, skip_special_tokens=False)
    rows, extra = odd_docs(spark)
    got = bpe.tokenize(extra, queries.vocabulary()).collect()
    want = sorted(((r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=str) == want
    assert bpe.tokenize(empty(spark), queries.vocabulary()).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=400, dim=8):
    """Rows that take part, padded, and a table that has odd ones as well."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.1, 3, (n, 1))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    short = [(1400, [9.0], 0), (1500, [-3.0, 5.0], 0)]
    odd = [(1000, None, 0), (1200, [1.0, None] * 4, 0), (1300, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (1600, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows + short + odd + [rows[0]], VECTORS).withColumns({"cell": F.lit(1), "at": F.lit("x"), "part": F.lit(2)})
    return rows + [(i, v + [0.0] * (dim - len(v)), 0) for i, v, _ in short], df


def by_query(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(rows) for q, rows in out.items()}


def test_exact_topk_is_exact(spark):
    rows, df = vectors(spark)
    df = df.unionByName(spark.createDataFrame([(1700, [], 0)], VECTORS), allowMissingColumns=True)  # a zero vector
    got = by_query(exact_topk.integer_topk(df, 50, 1024, 10))
    ids = np.array([r[0] for r in rows] + [1700, 0])  # row 0 is there twice
    x = np.floor(1024 * np.array([r[1] for r in rows] + [[0.0] * 8, rows[0][1]], float)).astype(np.int64)
    queries = [i for i in sorted(set(ids.tolist())) if i % 50 == 0]
    assert sorted(got) == queries and {1400, 1500, 1700} <= set(queries)
    for q in queries:
        s = x @ x[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert got[q] == [(n + 1, ids[i], s[i]) for n, i in enumerate(order)]
    assert exact_topk.integer_topk(empty(spark, VECTORS)).count() == 0
    assert exact_topk.integer_topk(spark.createDataFrame(rows[:3], VECTORS)).count() == 2
    assert dict(exact_topk.integer_topk(df).dtypes)["score"] == "bigint"


def test_exact_topk_of_great_numbers(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 64)) * 3e4).astype(np.float32)
    x[7:20] = x[7]
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], VECTORS)
    whole = [[int(np.floor(1024 * float(v))) for v in r] for r in x]
    got = by_query(exact_topk.integer_topk(df, 100, 1024, 10))
    for q in (0, 100, 200):
        s = [sum(a * b for a, b in zip(r, whole[q])) for r in whole]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:10]
        assert got[q] == [(n + 1, i, s[i]) for n, i in enumerate(want)] and max(s) > 2**53
    q, y = np.array([[2.0**40, 1.0, 3.0]]), np.array([[2.0**20, 5.0, -7.0]])
    assert products(q, y, True).tolist() == [2**60 + 5 - 21]
    with pytest.raises(OverflowError):
        products(q * 2.0**20, y * 2.0**20, True)


def clustered(spark, n=6000, clusters=40, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(clusters, dim))
    x = (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.2).astype(np.float32)
    return x, spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], VECTORS)


def test_the_index_opens_few_annuli_of_clustered_vectors(spark):
    x, df = clustered(spark)
    rows, dim = exact_topk.whole_vectors(df)
    opened = exact_topk.search(rows, rows.where("vec_id % 100 = 0"), dim, 10, whole=True, count_opened=True).head()[0]
    assert opened < 0.15 * 60 * len(x)


def test_learned_ann_against_brute_force(spark):
    x, df = clustered(spark)
    df = df.unionByName(spark.createDataFrame([(9000, [0.0] * 16, 0), (9020, [], 0)], VECTORS))
    got, hits = by_query(learned_ann.nearest(df, 20, 20)), 0
    assert sorted(got) == list(range(0, 6000, 20))  # zero vectors take no part
    y = x.astype(float)
    for q, rows in got.items():
        s = np.multiply(y, y[q]).sum(1)
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(score == s[i] for _, i, score in rows)
        assert [(-score, i) for _, i, score in rows] == sorted((-score, i) for _, i, score in rows) and q not in [i for _, i, _ in rows]
        s[q] = -np.inf
        hits += len({i for _, i, _ in rows} & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    rows, dim = usable(df)
    index = learned_ann.Index(rows.where("exists(vector, v -> v <> 0)"), dim)
    assert index.counts.sum() == 6000 and len(index.counts) == 12
    assert index.counts.max() <= learned_ann.BALANCE * index.counts.mean() and index.probes <= 4


def test_learned_ann_at_every_size(spark):
    assert learned_ann.nearest(empty(spark, VECTORS)).count() == 0
    rows, odd = vectors(spark)
    got = by_query(learned_ann.nearest(odd, 20, 20))
    assert {len(r) for r in got.values()} == {20} and {0, 20, 1400, 1500} <= set(got)
    for n in (1, 2, 3, 30, 100):
        few = by_query(learned_ann.nearest(spark.createDataFrame(rows[:n], VECTORS), 20, 20))
        assert sorted(few) == ([] if n == 1 else list(range(0, n, 20)))
        if n <= 3:
            assert all(len(r) == n - 1 for r in few.values())
    assert [learned_ann.part_count(n) for n in (0, 1, 2, 39, 100, 1000, 10**5, 10**9)] == [0, 1, 2, 2, 5, 12, 24, learned_ann.MOST_PARTS]
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(500)], VECTORS)  # copies of one vector
    assert {len(r) for r in by_query(learned_ann.nearest(same, 20, 20)).values()} == {20}


def test_learned_ann_recall_with_skewed_norms():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12_000, 16))
    x *= np.exp(rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    router, probes = learned_ann.learn(x[:6000], 12, 20)
    order, hits = router.order(x), 0
    sizes = np.bincount(order[:, 0], minlength=12)
    assert sizes.max() <= 1.4 * sizes.mean()
    for q in range(0, len(x), 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits += np.isin(order[np.argpartition(-s, 20)[:20], 0], order[q, :probes]).sum()
    assert hits / (120 * 20) >= 0.93


def test_hilbert_curve_and_shards(spark):
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    rows, extra = odd_docs(spark)
    got = sharding.shard_documents(extra, ["lang", "source", "n_chars"], 4).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)
    import zlib

    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t[1] or "").encode()) + 1, zlib.crc32((t[1] or "").encode())) for t in rows)
    assert sharding.shard_documents(empty(spark), ["lang"], 4).count() == 0
    assert sharding.file_ranges(sharding.shard_documents(extra, ["lang"], 4), ["lang"]).count() == 4
    assert {r["_axis0"] for r in sharding.hilbert_shards(extra, ["lang"], [F.col("doc_id")], 3).collect()} == {"own _axis0"}


def test_shards_can_be_skipped(spark):
    """Files of one value of a dimension are few: lang and source are told apart by their order."""
    rng = random.Random(3)
    rows = [(i, "x", f"l{rng.randrange(8)}", f"src{rng.randrange(20):02d}", rng.randrange(10_000)) for i in range(8000)]
    columns = ["lang", "source", "n_chars"]
    found = sharding.hilbert_shards(spark.createDataFrame(rows, DOCS), columns, [F.col("doc_id")], 64)
    ranges = sharding.file_ranges(found, columns).collect()
    asked = {"lang": "l3", "source": "src07", "n_chars": 5000}
    open_ = {c: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in ranges) for c, v in asked.items()}
    assert all(n <= 40 for n in open_.values()) and sum(open_.values()) <= 90, open_
    cells = dict(sharding.cuts(spark.createDataFrame([(i // 100,) for i in range(1600)], "v int"), "v"))
    assert cells == {i: i for i in range(16)} and sharding.cuts(spark.createDataFrame([(None,)], "v int"), "v") == []


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 10), ("b", "x", 1000), ("b", "z", 5)], "l1 string, l2 string, tokens long")
    got = {(r[0], r[1]): r["alloc"] for r in mixing.budgets(leaves, ["l1", "l2"], {("a",): 3}, 400, 2).collect()}
    # a wants 300 of 400 but holds 220: b gets 180; y's and z's shortages go to their siblings.
    assert got == {("a", "x"): 200, ("a", "y"): 20, ("b", "x"): 170, ("b", "z"): 10}
    rows, extra = odd_docs(spark)
    levels = {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")}
    taken = mixing.mix(extra, levels, {}, (1, 1), 2, 1).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r["_mix_taken"] for r in taken) >= total - 1 and all(0 < r["_mix_taken"] <= r["_mix_tokens"] for r in taken)
    assert mixing.mix(empty(spark), levels, {}).count() == 0
    cut = spark.createDataFrame([(" a  b\nc ", 2)], "t string, n int").select(mixing.first_words(F.col("t"), F.col("n")))
    assert cut.head()[0] == " a  b"


def labelled(spark, n=900):
    rng, docs, labels = random.Random(5), [], []
    for i in range(n):
        w = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randrange(5, 80))]
        good, toxic = i % 5 != 0, i % 6 == 1
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[:: max(1, len(w) // 4)] = [rng.choice(["vilest", "horrid", "rotten"]) for _ in w[:: max(1, len(w) // 4)]]
        docs.append((i, " ".join(w), "en", "s", 1))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (10**6, 0, 1), (3, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, modulus, remainder):
    rows = scored.join(labels, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"), modulus, remainder)).where(f"held and {label} is not null").collect()
    return np.mean([(r["score"] >= 0.5) == (r[label] == 1) for r in rows])


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    assert accuracy(quality.score(docs, model), labels, "quality", 3, 1) >= 0.97
    rows, extra = odd_docs(spark)
    scores = [r["_s"] for r in quality.score(extra, model, "_s").collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    none = quality.train(docs, empty(spark, "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality.score(docs.limit(5), none).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


def plain_features(text):
    """What quality.features says of one text, character by character."""
    raw, low = text.encode(), re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    cased, words = re.findall(rb"[^\x20\x09-\x0d]+", raw), re.findall(rb"[^\x20\x09-\x0d]+", low)
    lines, n, k = [x for x in low.split(b"\n") if x], max(len(raw), 1), max(len(words), 1)
    up, letter = rb"[A-Z]", rb"[a-z\x80-\xff]"

    def share(pattern):
        return sum(bool(re.search(pattern, w)) for w in cased) / k

    ups, letters = len(re.findall(up, raw)), len(re.findall(rb"[A-Za-z\x80-\xff]", raw))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / k, ups / max(letters, 1), len(re.findall(rb"[0-9]", raw)) / n,
        len(re.findall(rb"[#$%&*+/<=>@\\^_`{}~\[\]]", raw)) / k, len(re.findall(rb"[!?]", raw)) / k, *[raw.count(c) / k for c in (b"|", b".", b",", b"\n")],
        len(set(words)) / k, share(rb"^[A-Z]"), 1 - share(rb"[A-Za-z\x80-\xff]") if words else 0.0,
        1 - share(rb"[A-Za-z0-9.,;:\x80-\xff]$") if words else 0.0, sum(bool(re.search(up, w)) and not re.search(letter, w) for w in cased) / k,
        sum(len(w) <= 2 for w in words) / k, len(set(lines)) / max(len(lines), 1), len(re.findall(rb"[\x80-\xff]", raw)) / n,
    ]


def test_quality_scores_against_a_plain_version(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    rows, extra = odd_docs(spark)
    both = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    for r in quality.score(both, model, "s").collect():
        x, raw = plain_features(r["text"] or ""), model.intercept
        at = [int(np.searchsorted(c, v, "right")) for c, v in zip(model.cuts, x)]
        raw += sum(t[i] for t, i in zip(model.tables, at)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert abs(r["s"] - 1 / (1 + np.exp(-raw))) < 1e-9
    assert quality.score(extra, model).select("_score", "score").dtypes == [("_score", "string"), ("score", "double")]


def test_toxicity_scores_against_a_plain_version(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights))

    def features(text):
        for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).encode())):
            for most in (None, 4, 6):
                h = Words(np.frombuffer(w[:most], np.uint8), np.array([0, len(w[:most])]), ALNUM).hashes()[0]
                yield int(h) + (most or 0)

    rows, extra = odd_docs(spark)
    both = docs.select("doc_id", "text").unionByName(extra.where("doc_id is null or doc_id <> 6").select("doc_id", "text"))
    for r in toxicity.score(both, model, "s").collect():
        raw = model.intercept + sum(weight.get(h, 0.0) for h in set(features(r["text"] or "")))
        assert abs(r["s"] - 1 / (1 + np.exp(-raw))) < 1e-9
    assert len(model.hashes) > 0


def test_the_risk_of_the_unlabelled_is_not_negative():
    """Where unlabelled texts have the features that confirmed ones have, weights don't run away."""
    n = 50
    p = (np.ones(n, np.int64), np.zeros(n, np.int64))
    u = (np.append(np.ones(5, np.int64), np.zeros(95, np.int64)), np.zeros(5, np.int64))
    model = toxicity.fit(p, u, np.array([3], np.uint64), 0.1)
    sure = 1 / (1 + np.exp(-(model.intercept + model.weights[0])))
    assert sure > 0.5 and 1 / (1 + np.exp(-model.intercept)) < 0.2 and abs(model.weights[0]) < 30


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic", 5, 0) >= 0.95
    rows, extra = odd_docs(spark)
    scores = [r["_s"] for r in toxicity.score(extra, model, "_s").collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    none = toxicity.train(docs, empty(spark, "doc_id long, quality int, toxic int"))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs.limit(5), none).collect())
    assert toxicity.train(empty(spark), empty(spark, "doc_id long, quality int, toxic int")).hashes.size == 0


def test_html_wrapper(spark):
    def page(i, extra=""):
        return (
            f"<html><head><title>T{i}</title><script>var a='<p>x</p>'</script></head><body><header><h1>Site</h1></header><nav><ul><li>a{i}<li>b</ul></nav>"
            f"<div class='story'><h2>Title {i}</h2><p>First   &amp; {i}<br>line<p><b>Second {i}</p><p>Call us today</p></div>"
            f"<div id=comments><p>reader {i}</p></div><aside>ad {i}</aside><footer>&copy; {i}</footer>{extra}</body>"
        )

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    rows += [(100, None, None), (101, "http://one.example/", "<p>only <!-- no --> text"), (102, "x", ""), (103, "http://two.example", "<main><p>A&lt;B</p></main><p>out")]
    rows += [(104, "http://h.example/1", page(1)), (None, "http://deep.example", "<div>" * 300 + "deep" + "</div>" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("x")})
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\nFirst & {i} line\nSecond {i}"  # the constant line is template
    assert got[100] == "" and got[101] == "only text" and got[102] == "" and got[103] == "A<B" and got[104] == got[1] and got[None] == "deep"
    assert html_wrapper.main_text(empty(spark, "page_id long, url string, html string")).count() == 0


def test_html_names_and_regions(spark):
    def page(i):
        return (
            f"<body class='single no-sidebar'><div class='top'>Hosted by us</div><main class='content has-sidebar'><h1>Head {i}</h1><p>Lead {i}</p>"
            f"<article class='with-comments'><p>Body of story number {i}</p></article><div class='cookie-banner'>eat {i}</div></main></body>"
        )

    def blog(i):
        story = f"<div class='story'><p>The long story of day {i}, told in full</p></div>"
        return f"<body><div class='top'>Hosted by us</div>{story}<article><p>Read this teaser</p></article><article><p>And that teaser</p></article><div id='comment-{i}'>hi {i}</div>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(6)] + [(10 + i, f"http://b.example/{i}", blog(i)) for i in range(6)]
    rows += [(20, "http://lone.example/", page(9)), (21, "http://lonely.example/", blog(9))]
    rows += [(22, "http://x.example/", "<div class='no-sidebar'><p>kept</p></div><div class='navMenu'>gone</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\nLead {i}\nBody of story number {i}"
        assert got[10 + i] == f"The long story of day {i}, told in full"
    assert got[20] == "Head 9\nLead 9\nBody of story number 9" and "The long story of day 9, told in full" in got[21] and got[22] == "kept"


def test_html_odd_pages(spark):
    def one(page):
        return "\n".join(html_wrapper.extract(page))

    assert one("foo<wbr>bar <i>b</i>az<br>qux<img src=x>ed") == "foobar baz quxed"
    depth = 10_000
    deep = [f"<div>head {i}" + "<div>" * depth + f"<p>deep {i}" for i in range(2)] + ["<b>" * depth + "x" + "<p>y" * 3]
    for page in deep:
        nodes = html_wrapper.parse(page)
        shape, places = html_wrapper.folded(nodes)
        known = {}
        tree = html_wrapper.tree_of(shape, known)
        assert html_wrapper.shape_of(tree) == shape and tree.size == len(places)
        assert html_wrapper.aligned(html_wrapper.merge(tree, html_wrapper.tree_of("0:html. 1:p.", known), {}, known), tree, {})[0] == 0
    rows = [(i, "http://deep.example/", page) for i, page in enumerate(deep)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "head 0\ndeep 0" and got[2] == "x\ny\ny\ny"


def test_tree_matching():
    known = {}
    a, b = (html_wrapper.tree_of(x, known) for x in ("0:r 1:x 1:y 2:z 1:x", "0:r 1:y 2:z 2:w 1:x 1:q"))
    assert html_wrapper.match(a, b, {})[0] == 4
    wrapper = html_wrapper.merge(a, b, {}, known)
    assert html_wrapper.shape_of(wrapper) == "0:r 1:x 1:y 2:z 2:w 1:x 1:q"
    assert html_wrapper.aligned(wrapper, b, {}) == [0, 2, 3, 4, 5, 6] and html_wrapper.aligned(b, a, {}) == [0, -1, 1, 2, 4]

    def plain(x, y):
        if x.label != y.label:
            return 0
        best = [[0] * (len(y.kids) + 1) for _ in range(len(x.kids) + 1)]
        for i, c in enumerate(x.kids):
            for j, d in enumerate(y.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(c, d))
        return 1 + best[-1][-1]

    rng = random.Random(1)
    for _ in range(60):
        shapes = []
        for _ in range(2):
            depth, words = 0, ["0:r"]
            for _ in range(rng.randrange(14)):
                depth = rng.randrange(1, depth + 2)
                words.append(f"{depth}:{rng.choice('ab')}")
            shapes.append(html_wrapper.tree_of(" ".join(words), known))
        assert html_wrapper.match(*shapes, {})[0] == plain(*shapes)


def article(page):
    """The blocks of the given pages' article elements, by their known shape."""
    out = []
    for part in re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*)</article>", page, re.S)[1]):
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", part.replace("<br>", " "))).split())
        out += [text] if text else []
    return "\n".join(out)


@needs_data
def test_html_on_the_pages(spark):
    """On the given pages the text is that of the article; also without any name that says so, where the
    wrapper alone can tell; and when templates are sorted in front of pages and not broadcast."""
    pages = queries.table(spark, DATA.replace("0.001", "0.01"), "pages")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer)>", "<$1div>"), ' class="ad"', "")
    for df, most in ((pages, html_wrapper.BROADCAST_BYTES), (pages.withColumn("html", bare), html_wrapper.BROADCAST_BYTES), (pages, 0)):
        assert {r["page_id"]: r["text"] for r in html_wrapper.main_text(df, most).collect()} == want
    found = html_wrapper.induce(pages)
    assert found.where("pages < 2").isEmpty() and found.where(F.size("roots") > 0).count() == found.count() > 10


def brute_notices(text):
    w, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), {}
    for t, (_, template, telling) in enumerate(licenses.TEMPLATES):
        own, span = set(template.split()), 2 * len(template.split())
        for i in range(len(w)):
            held = own & set(w[i : i + span])
            if 10 * len(held) >= 8 * len(own) and set(telling.split()) <= held:
                out[t] = max(out.get(t, 0), len(held) / len(own))
    return out


def test_licenses(spark):
    rows, extra = odd_docs(spark)
    assert licenses.scan(extra).count() == len(rows) and licenses.scan(empty(spark)).count() == 0
    text = "intro\nReleased under the MIT License.\nSee the MIT license, Apache License. GNU general  public-license"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert sorted((p["label"], p["word"]) for p in r["places"]) == [("apache", 10), ("gpl", 13), ("mit", 4), ("mit", 8)]
    assert [tuple(n) for n in r["notices"] if n["label"] == "mit"] == [("mit", [t[1] for t in licenses.TEMPLATES].index("released under the mit license"), 1, 5, 1.0)]
    rng = random.Random(6)
    vocab = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) + ["other", "words"]
    docs = []
    for i in range(200):
        parts = []
        for _ in range(3):
            own = rng.choice(licenses.TEMPLATES)[1].split()
            own = [w for w in own if rng.random() < 0.93]
            for _ in range(rng.randrange(4)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(vocab))
            parts += own + rng.choices(vocab, k=rng.randrange(30))
        docs.append((i, "".join(w + rng.choice([" ", "\n", ", "]) for w in parts)))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        best = {}
        for n in r["notices"]:
            best[n["template"]] = max(best.get(n["template"], 0), n["containment"])
        assert best == brute_notices(docs[r["doc_id"]][1])
    assert sum(len(r["notices"]) for r in got) > 100


def licence_labels(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_licenses(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL["op10_licenses"]).order("doc_id")
    rows = found.orderBy("doc_id").select(*want.columns).collect()
    assert [tuple(r) for r in rows] == want.fetchall()
    return [(r["labels"], r["score"]) for r in rows]


def test_licenses_wrapped_over_lines(spark, tmp_path):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"
    cc = "This work is licensed under a Creative Commons\nAttribution 4.0 International License."
    narrow = "/*\n * " + "\n * ".join(bsd.replace("\n", " ").split()) + "\n */"
    texts = [bsd, isc, cc, narrow, "Some code.\r\n" + bsd.replace("\n", "\r\n"), bsd.split("\n")[0], "modification, are permitted"]
    texts.append("\n".join(f"{w} {' '.join(WORDS * 4)}" for w in bsd.split()))  # the words of a notice, strewn over prose
    texts += ["Licensed under CC BY-NC 4.0.", "// SPDX-License-Identifier: MIT", None, ""]
    got = licence_labels(spark, tmp_path, texts)
    assert got == [("bsd", 1.0), ("isc", 1.0), ("cc", 1.0), ("bsd", 1.0), ("bsd", 1.0), ("", 0.0), ("", 0.0), ("", 0.0), ("cc", 1.0), ("mit", 1.0), ("", 0.0), ("", 0.0)]


def test_licenses_hold_the_words_that_name_them(spark, tmp_path):
    texts = ["Released under the Apache License.", "Released under the XYZ License.", "Released under the\nGPL license.", "Released under the MIT License."]
    texts += ["Subject to the terms of the Eclipse Public License.", "Released under the MIT\nLicense."]
    texts.append(" ".join(["released", *WORDS, "under", *WORDS, "the", *WORDS, "license"] * 50))
    want = [("apache", 1.0), ("", 0.0), ("", 0.0), ("mit", 1.0), ("", 0.0), ("mit", 1.0), ("", 0.0)]
    assert licence_labels(spark, tmp_path, texts) == want


@needs_data
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted(str([r[x] for x in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


@needs_data
def test_op3_digests(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, DATA, "documents").collect()}
    for r in queries.op3_bpe(spark, DATA).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as p

    assert p.ORACLE_SQL is None and len(p.STAGES) == 5
    docs = queries.table(spark, DATA, "documents")
    kept = p.drop_near_copies(spark, docs, DATA)
    groups = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g[2] for g in groups})
    assert kept.columns == docs.columns
    mixed = p.mix_sources(spark, kept, DATA)
    assert mixed.columns == docs.columns
    out = p.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


@needs_data
def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as p

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    rows, extra = odd_docs(spark)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, extra, DATA)
        assert out.columns == extra.columns, name
        assert all(r["_mix_lang"] == "own _mix_lang" and r["_id"] == "own _id" for r in out.collect()), name
        assert stage(spark, empty(spark), DATA).count() == 0, name
    want = sorted(((r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in p.encode(spark, extra, DATA).collect()), key=str) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in p.encode(spark, extra, DATA).collect()) and p.encode(spark, empty(spark), DATA).count() == 0


@needs_data
def test_pipeline_stages_keep_their_rows(spark, monkeypatch):
    import corpus_pipeline as p

    docs, labels = queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "labels")
    rows = [tuple(r) for r in docs.collect()]
    for stage, module, keeps in ((p.keep_quality, quality, lambda s: s >= 0.5), (p.drop_toxic, toxicity, lambda s: s < 0.5)):
        scored = module.score(docs, module.train(docs, labels), "_s").collect()
        want = sorted((tuple(r)[:-1] for r in scored if keeps(r["_s"])), key=str)
        assert sorted((tuple(r)[:-1] for r in scored), key=str) == sorted(rows, key=str)
        assert sorted(map(tuple, stage(spark, docs, DATA).collect()), key=str) == want
    for name, value in (("MIX_SHARE", p.SHARE), ("MIX_EPOCHS", p.EPOCHS), ("MIX_SEED", p.SEED)):
        monkeypatch.setattr(queries, name, value)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    taken = c.sql(f"SELECT doc_id, n_tokens, taken FROM ({queries._sql_mixing()})").fetchall()
    texts, want = {r[0]: r for r in rows}, []
    for doc_id, n, k in taken:
        r = dict(zip(docs.columns, texts[doc_id]))
        if k < n:
            r["text"] = r["text"][: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"])][k - 1]]
            r["n_chars"] = len(r["text"])
        want.append(tuple(r.values()))
    assert sorted(map(tuple, p.mix_sources(spark, docs, DATA).collect()), key=str) == sorted(want, key=str)
