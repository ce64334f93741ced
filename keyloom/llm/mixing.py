"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree (for instance domain, language, source). The token budget of a node is shared
among its children by weight; a child whose subtree cannot supply its share (tokens times the
epochs allowed) gives the rest to its siblings by their weights, and only what no sibling can take
was never asked of the node by its parent, because a node's share is limited to what its subtree
holds. So shortages are made good among siblings first, then among ancestors' siblings. A leaf's
tokens come from seeded epochs: whole epochs, then a prefix of the next epoch's order, whose last
document is taken in part. All amounts are integers, so the result is exact.

Only built-in functions. No leaf is ordered in one task: rows are bucketed by the first digits of
their seeded hash, more digits for more rows. Tables of tree nodes hold a row for each node.

A null level value is a node of its own. A null text, or one without words, has no tokens and is
never taken. A null doc_id hashes as the text null. Repeated rows are rows like any other. If the
budget exceeds the supply, everything is taken as often as allowed. Ties in the order of an epoch go
to the text with fewer tokens; nodes equally full are served in the order of their names. An empty
table gives no rows. Columns that docs has beside those named stay, but for columns that begin with
_mix_, the names of the result, which are left out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.shared import prefix_sums, stash

BUCKET_ROWS = 50_000
#: Words of a text; the unit in which budgets are counted.
WORD = r"[^\x20\x09-\x0D]+"
NULL = "<null>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(path: list[str], weights: dict[tuple, int]) -> Column:
    """The weight of each node at this depth: a literal table, 1 if it isn't named."""
    named = {k: v for k, v in weights.items() if len(k) == len(path)}
    out = F.lit(1).cast("long")
    for key, w in named.items():
        same = F.lit(True)
        for column, value in zip(path, key):
            same = same & (F.col(column) == F.lit(value))
        out = F.when(same, F.lit(w).cast("long")).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple, int], budget: int, epochs: int) -> DataFrame:
    """levels, tokens and alloc (tokens to take, long) of each leaf. leaves: levels, tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    parent: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        path, above = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(path, weights))
        if parent is None:
            everything = Window.partitionBy(F.lit(1))
            nodes = nodes.withColumn("b", F.least(F.lit(budget).cast("long"), F.sum("cap").over(everything)))
        else:
            nodes = nodes.join(parent, above)
        group = [F.col(c) for c in above] or [F.lit(1)]
        order = [F.col("cap") / F.col("w"), *[F.col(c) for c in path]]
        to_here = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*group)
        big = "decimal(38,0)"
        nodes = nodes.withColumn("before", F.sum("cap").over(to_here) - F.col("cap"))
        nodes = nodes.withColumn("rest_w", F.sum("w").over(whole) - F.sum("w").over(to_here) + F.col("w"))
        full = F.col("cap").cast(big) * F.col("rest_w") <= (F.col("b") - F.col("before")).cast(big) * F.col("w")
        nodes = nodes.withColumn("full", full)
        nodes = nodes.withColumn("left_b", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        nodes = nodes.withColumn("left_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
        share = F.expr("cast(case when full then cap else (cast(left_b as decimal(38,0)) * w) div left_w end as bigint)")
        nodes = nodes.withColumn("share", share)
        spare = F.col("b") - F.sum("share").over(whole)
        place = F.row_number().over(Window.partitionBy(*group).orderBy("full", *path))
        nodes = nodes.withColumn("alloc", F.col("share") + F.when(~F.col("full") & (place <= spare), 1).otherwise(0))
        parent = nodes.select(*path, F.col("alloc").alias("b"))
    return leaves.join(parent, levels).select(*levels, "tokens", F.col("b").alias("alloc"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, int], share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 1,
    tokens: Column | None = None, narrow: tuple[str, ...] | None = None,
) -> DataFrame:
    """The rows taken, once for each epoch: columns of docs (or those of narrow, then counted words
    are written first and texts are read once), the levels, _mix_epoch (from 0),
    _mix_tokens (of the document) and _mix_taken (of them, from its start). The budget is
    share[0] / share[1] of all tokens, rounded down. levels: name and expression, root first."""
    names = [f"_mix_{k}" for k in levels]
    rows = docs.drop(*[c for c in docs.columns if c.lower().startswith("_mix_")]).withColumns(
        {n: F.coalesce(c.cast("string"), F.lit(NULL)) for n, c in zip(names, levels.values())}
        | {"_mix_tokens": word_count(F.col("text")) if tokens is None else tokens}
    )
    if narrow is not None:
        rows = stash(rows.select(*narrow, *names, "_mix_tokens"), "words")
    leaves = stash(rows.groupBy(*names).agg(F.sum("_mix_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total = leaves.agg(F.sum("tokens").alias("t"), F.sum("rows").alias("r")).head()
    budget = (total["t"] or 0) * share[0] // share[1]
    digits = max(1, math.ceil(math.log(max(1, (total["r"] or 0) / BUCKET_ROWS), 16)))
    named = {tuple(k): v for k, v in weights.items()}
    plan = budgets(leaves.where("tokens > 0"), names, named, budget, epochs)
    plan = stash(plan.select(*names, F.expr("alloc div tokens").alias("_mix_whole"), F.expr("alloc % tokens").alias("_mix_rest")), "plan")
    rows = rows.where("_mix_tokens > 0").join(plan, names)
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("_mix_key", F.md5(F.concat_ws(":", F.lit(seed), "_mix_whole", text_id)))
    rows = rows.withColumn("_mix_bucket", F.substring("_mix_key", 1, digits))
    ties = [F.col("_mix_key"), F.col("_mix_tokens")]
    rows = prefix_sums(rows, names, "_mix_bucket", ties, F.col("_mix_tokens"), "_mix_before")
    last = F.least(F.greatest(F.col("_mix_rest") - F.col("_mix_before"), F.lit(0)), F.col("_mix_tokens"))
    rows = rows.withColumn("_mix_epoch", F.explode(F.expr("sequence(0, cast(_mix_whole as int))")))
    rows = rows.withColumn("_mix_taken", F.when(F.col("_mix_epoch") < F.col("_mix_whole"), F.col("_mix_tokens")).otherwise(last))
    rows = rows.where("_mix_taken > 0").drop("_mix_whole", "_mix_rest", "_mix_key", "_mix_bucket", "_mix_before")
    own = {c.lower() for c in rows.columns}
    free = {k: f"_mix_{k}" for k in levels if k.lower() not in own}
    return rows.withColumnsRenamed({v: k for k, v in free.items()}).drop(*[f"_mix_{k}" for k in levels if k not in free])


def first_words(text: Column, n: Column) -> Column:
    """The start of the text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), F.lit(1), n.cast("int")), "")
