"""The queries op1 to op10 over whole tables, with the digest columns that compare them, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import hashing
from keyloom.llm import bpe, exact_topk, html_wrapper, learned_ann, licenses, mixing, ngram_join, quality, sharding, toxicity

#: Target weights of the mixture; nodes that aren't named weigh 1.
MIX_WEIGHTS = {("d0",): 3, ("d1", "en"): 2}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 2), 2, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file that op3 and the pipeline use; any other path will do as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def mix_levels() -> dict:
    """Domain (by the number of the source, modulo 4), language, source."""
    number = F.expr(r"try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4")
    return {"domain": F.concat(F.lit("d"), number.cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.col("text"), *[c.alias(f"at_{k}") for k, c in mix_levels().items()])
    levels = {k: F.col(f"at_{k}") for k in ("domain", "lang", "source")}
    taken = mixing.mix(docs, levels, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED, narrow=("doc_id",))
    return taken.select(
        "doc_id", "domain", "lang", "source", F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("n_tokens"),
        F.col("_mix_taken").alias("taken"),
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.integer_topk(table(spark, sf_dir, "embeddings"), 100, 1024, 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary())
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_ann.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"), 3, 90, 100).drop("key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), 3, 1))
    return _scores(scored, 3, 1)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("long").alias("curve"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), 5, 0))
    return _scores(scored, 5, 0)


def _scores(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_wrapper.main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.col("places.word")
    base, extra = F.col("places.label"), F.col("notices.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, extra)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.containment"), F.lit(0.0))).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_exact_topk, op3_bpe, op4_learned_ann, op5_ngram_join, op6_quality, op7_hilbert_shards, op8_toxicity,
        op9_html_wrapper, op10_licenses,
    )
}


# ---------------------------------------------------------------- DuckDB


def _sql_mixing() -> str:
    levels = ["domain", "lang", "source"]
    ctes = [
        r"""d AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), '<null>') AS domain,
            coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)""",
        f"total AS (SELECT CAST(sum(n) AS HUGEINT) * {MIX_SHARE[0]} // {MIX_SHARE[1]} AS b FROM d)",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) AS HUGEINT) * {MIX_EPOCHS} AS cap "
        "FROM d GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for depth in range(1, 4):
        path, above = levels[:depth], levels[: depth - 1]
        keys = ", ".join(path)
        cases = "".join(
            f" WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(path, k))} THEN {w}" for k, w in MIX_WEIGHTS.items() if len(k) == depth
        )
        weight = f"CASE{cases} ELSE 1 END" if cases else "1"
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        b = "least((SELECT b FROM total), sum(cap) OVER ())" if depth == 1 else "b"
        source = "" if depth == 1 else f" JOIN (SELECT {', '.join(above)}, alloc AS b FROM s{depth - 1}) USING ({', '.join(above)})"
        ctes += [
            f"n{depth} AS (SELECT {keys}, cap, CAST({weight} AS HUGEINT) AS w, CAST({b} AS HUGEINT) AS b FROM "
            f"(SELECT {keys}, CAST(sum(cap) AS HUGEINT) AS cap FROM leaf GROUP BY ALL){source})",
            f"o{depth} AS (SELECT *, CAST(sum(cap) OVER up AS HUGEINT) - cap AS before, "
            f"CAST(sum(w) OVER (PARTITION BY {', '.join(above) or '1'}) AS HUGEINT) - CAST(sum(w) OVER up AS HUGEINT) + w AS rest_w FROM n{depth} "
            f"WINDOW up AS ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {keys} ROWS UNBOUNDED PRECEDING))",
            f"f{depth} AS (SELECT *, cap * rest_w <= (b - before) * w AS full_up FROM o{depth})",
            f"g{depth} AS (SELECT *, b - CAST(sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({by}) AS HUGEINT) AS left_b, "
            f"CAST(sum(CASE WHEN full_up THEN 0 ELSE w END) OVER ({by}) AS HUGEINT) AS left_w FROM f{depth})",
            f"h{depth} AS (SELECT *, CASE WHEN full_up THEN cap ELSE left_b * w // left_w END AS share FROM g{depth})",
            f"s{depth} AS (SELECT {keys}, share + CASE WHEN NOT full_up AND row_number() OVER ({by} ORDER BY full_up, {keys}) <= "
            f"b - CAST(sum(share) OVER ({by}) AS HUGEINT) THEN 1 ELSE 0 END AS alloc FROM h{depth})",
        ]
    ctes += [
        "plan AS (SELECT domain, lang, source, CAST(alloc // tokens AS BIGINT) AS whole, CAST(alloc % tokens AS BIGINT) AS rest "
        "FROM s3 JOIN leaf USING (domain, lang, source))",
        f"r AS (SELECT *, md5('{MIX_SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM d "
        "JOIN plan USING (domain, lang, source) WHERE n > 0)",
        "q AS (SELECT *, CAST(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, n ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS before FROM r)",
        "e AS (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM q)",
        "t AS (SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, n AS n_tokens, "
        "CAST(CASE WHEN epoch < whole THEN n ELSE least(greatest(rest - before, 0), n) END AS BIGINT) AS taken FROM e)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT * FROM t WHERE taken > 0"


_SQL_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL_NGRAMS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
x AS (SELECT doc_id, unnest(s) AS g FROM sets),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 90 * (p.n_shingles + q.n_shingles - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, n.n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2
"""


def _sql_licenses() -> str:
    places = " UNION ALL ".join(
        "SELECT doc_id, '{}' AS label, unnest(list_filter(range(1, len(w) - {}), lambda i: {})) - 1 AS place FROM d".format(
            label, len(p.split()) - 2, " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split()))
        )
        for p, label in licenses.PHRASES.items()
    )
    v = licenses.Vocabulary()
    templates = " UNION ALL ".join(
        f"SELECT {t} AS t, '{v.labels[t]}' AS label, {len(s)} AS size, {v.need[t]} AS need, {v.spans[t]} AS span, {v.telling[:, t].sum()} AS tell, "
        f"unnest({s!r}) AS word, unnest({[bool(v.telling[v.words.index(w), t]) for w in s]!r}) AS telling"
        for t, s in enumerate(v.sets)
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM p GROUP BY 1),
t AS ({templates}),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
h AS (SELECT x.doc_id, x.place, t.* FROM x JOIN t USING (word)),
m AS (SELECT doc_id, label, size, need, tell, count(DISTINCT word) OVER block AS held, count(DISTINCT CASE WHEN telling THEN word END) OVER block AS told
  FROM h WINDOW block AS (PARTITION BY doc_id, t ORDER BY place RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING)),
mm AS (SELECT doc_id, max(held / CAST(size AS DOUBLE)) AS c, list(DISTINCT label) AS labels FROM m WHERE held >= need AND told = tell GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word,
  CAST(b.hi AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(mm.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(mm.c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN mm USING (doc_id)
"""


def _sql_shards(columns=("lang", "source", "n_chars"), shards: int = 16, bits: int = sharding.BITS) -> str:
    n = len(columns)
    ctes = [
        f"crc AS MATERIALIZED {hashing.CRC_STEPS_SQL}",
        f"d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 1 AS size, "
        f"{hashing.crc_sql(hashing.bytes_sql("coalesce(text, '')"))} AS text_crc32, {', '.join(columns)} FROM documents, crc)",
    ]
    for i, c in enumerate(columns):
        ctes.append(
            f"q{i} AS (SELECT {c}, CAST(((sum(n) OVER (ORDER BY {c}) - n) * {1 << bits}) // (sum(n) OVER ()) AS BIGINT) AS cell FROM "
            f"(SELECT {c}, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1))"
        )
    joins = " ".join(f"LEFT JOIN q{i} ON d.{c} = q{i}.{c}" for i, c in enumerate(columns))
    ctes.append(f"g AS (SELECT d.doc_id, size, text_crc32, {', '.join(f'coalesce(q{i}.cell, 0) AS x{i}' for i in range(n))} FROM d {joins})")
    at, step = "g", 0

    def then(**new: str) -> None:
        nonlocal at, step
        step += 1
        ctes.append(f"h{step} AS (SELECT doc_id, size, text_crc32, {', '.join(f'{new.get(f"x{i}", f"x{i}")} AS x{i}' for i in range(n))} FROM {at})")
        at = f"h{step}"

    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(n):
            swap = f"(xor(x0, x{i}) & {q - 1})"
            first = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END"
            then(**{"x0": first} | ({f"x{i}": f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END"} if i else {}))
    for i in range(1, n):
        then(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        turn = f"xor({turn}, CASE WHEN x{n - 1} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    then(**{f"x{i}": f"xor(x{i}, {turn})" for i in range(n)})
    curve = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    ids = [f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in ("doc_id", "size", "text_crc32")]
    ctes += [
        f"c AS (SELECT doc_id, size, text_crc32, CAST({curve} AS BIGINT) AS curve, md5({" || ':' || ".join(ids)}) AS h FROM {at})",
        "r AS (SELECT *, row_number() OVER (ORDER BY curve, h, doc_id, size, text_crc32) - 1 AS rank, count(*) OVER () AS total FROM c)",
        f"s AS (SELECT *, (rank * {shards}) // total AS shard FROM r)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, "
        f"CAST(rank - (shard * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM s"
    )


ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _sql_mixing(),
    "op2_exact_topk": _SQL_TOPK,
    "op5_ngram_join": _SQL_NGRAMS,
    "op7_hilbert_shards": _sql_shards(),
    "op10_licenses": _sql_licenses(),
}
