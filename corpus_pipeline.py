"""A corpus from raw documents: quality, toxicity, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs. All but the last return the columns of docs, whatever further columns it has
and whatever they are called.

Null and empty texts are documents like any other: the classifiers score them as empty texts, they
are no copies of anything, have no tokens (so the mixture never takes them) and encode to no ids.
Texts of any length are taken whole. Rows with a null doc_id are scored, kept by the near-copy stage
and mixed like others. Of rows equal in id and text one stays. An empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, mixing, ngram_join, quality, queries, toxicity
from keyloom.llm.shared import aside, free_name, stash
from keyloom.session import importable

#: The mixture takes three quarters of the tokens, a document at most twice.
SHARE, EPOCHS, SEED = (3, 4), 2, 7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: score 0.5 or more."""
    importable(spark)
    model, out = quality.train(docs, queries.table(spark, sf_dir, "labels")), free_name(docs, "_score")
    return quality.score(docs, model, out).where(F.col(out) >= 0.5).drop(out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject: score under 0.5."""
    importable(spark)
    model, out = toxicity.train(docs, queries.table(spark, sf_dir, "labels")), free_name(docs, "_score")
    return toxicity.score(docs, model, out).where(F.col(out) < 0.5).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    importable(spark)
    return ngram_join.one_of_each(docs, 5, 80, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights; a document taken in two epochs is there twice, and the last of
    a source's prefix is cut after its last word taken."""
    importable(spark)
    columns = docs.columns
    docs, names = aside(docs, "_mix_")
    taken = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, SHARE, EPOCHS, SEED)
    cut = F.col("_mix_taken") < F.col("_mix_tokens")
    taken = taken.withColumn("text", F.when(cut, mixing.first_words(F.col("text"), F.col("_mix_taken"))).otherwise(F.col("text")))
    taken = taken.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return taken.select(*docs.columns).withColumnsRenamed(names).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every document."""
    importable(spark)
    ids = bpe.tokenize(docs, queries.vocabulary(), ["doc_id", "lang", "source"], decoded=False)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: The classifiers and the token ids cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    importable(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
