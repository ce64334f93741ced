"""Toxicity by non-negative positive-unlabelled learning.

A logistic model of words and word beginnings is fitted in numpy to confirmed toxic texts (P) and
to texts of unknown kind (U) with the class-prior-corrected risk
    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1));
where the second term is negative the step goes against it, so it cannot be pushed below zero.
Labels of 0 are never used as examples; the prior is a parameter, or the share of toxic rows among
the usable labels. Features: presence of hashed words and of their first 4 and 6 bytes, those that
P has at least LIFT times as often as U and by more than SIGMAS standard deviations of chance.

Training reads at most `rows` confirmed texts and `unlabelled_rows` others, chosen by hash of the id
(documented bounds, both parameters; the others only say how common a feature is, so that more of
them sharpen its frequency and no more: the README has the recall with several). The model has every
feature that passes, there is no limit to their number; the driver holds the numbers of the features
that each sampled text has. Scoring streams over all rows with one small table.

A null text is an empty text. Without toxic examples scores are the prior. Rows with null ids are
scored and are not held out, and no training text. Repeated rows get equal scores; a repeated label
row counts as one more example. An empty table trains on nothing and gives no rows. The score column
replaces one of the same name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.labelled import remainder, sample, unlabelled
from keyloom.llm.quality import add_scores
from keyloom.llm.shared import ALNUM, Words, mix, stash, text_chunks, unstash

TRAIN_ROWS = 4_000
UNLABELLED_ROWS = 12_000
PRIOR, LIFT, SIGMAS = 0.1, 3.0, 5.0
STEPS, RATE, DECAY = 300, 0.1, 1e-3
BEGINNINGS = (None, 4, 6)
_TABLE = 1 << 20


def present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and word beginning, with repeats."""
    words = Words(data, offsets, ALNUM)
    hashes = [words.hashes(k) + np.uint64(k or 0) for k in BEGINNINGS]
    return np.tile(words.doc, len(hashes)), np.concatenate(hashes)


class Toxic:
    """Sorted feature hashes with their weights, and an intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float):
        self.hashes, self.weights, self.intercept = hashes, weights, intercept
        self.hit = np.zeros(_TABLE, bool)
        self.hit[(hashes & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def found(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, feature) of the model's features."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.hit[(h & np.uint64(_TABLE - 1)).astype(np.int64)]
        row, h = row[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[at] == h
        return np.divmod(np.unique(row[ok] * len(self.hashes) + at[ok]), len(self.hashes))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = self.found(*present(data, offsets))
        raw = self.intercept + np.bincount(row, self.weights[feature], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _distinct(texts: pa.Array, model: Toxic | None):
    """(rows, row, feature) of each run: distinct hashes of each text, or those of a model as
    their places in it."""
    for first, last, data, offsets in text_chunks(texts):
        row, h = present(data, offsets)
        if model is not None:
            row, h = model.found(row, h)
        else:
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(row)]
            row, h = row[new], h[new]
        yield last - first, row, h


def _counts(texts: DataFrame, model: Toxic | None) -> DataFrame:
    """(feature, n): how many texts have each feature, counted in the tasks first."""

    def run(batches):
        for batch in batches:
            kinds = [h for _, _, h in _distinct(batch.column(0), model)]
            feature, n = np.unique(np.concatenate(kinds), return_counts=True) if kinds else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])

    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def choose_features(p: DataFrame, u: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """Sorted hashes of the features that P has more often than chance allows. Counts are made on the
    executors; the driver gets features that enough confirmed texts have, a number that the bounded
    sample bounds."""
    often = _counts(p, None).where(F.col("n") >= SIGMAS).toArrow()
    hashes = often["feature"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, in_p = hashes[order], often["n"].to_numpy()[order]
    if not len(hashes):
        return hashes
    seen = _counts(u, Toxic(hashes, np.zeros(len(hashes)), 0.0)).toArrow()
    in_u = np.zeros(len(hashes), np.int64)
    in_u[seen["feature"].to_numpy()] = seen["n"].to_numpy()
    usual = n_p * (in_u + 1) / n_u  # expected in P if P were like U
    lift = in_p / usual
    good = np.flatnonzero((in_p - usual >= SIGMAS * np.sqrt(usual + 1)) & (lift >= LIFT))
    return hashes[good]


def fit(p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, prior: float) -> Toxic:
    """p, u: how many features each text has, and their places in hashes, one text after the other."""
    base = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(p[0]), len(u[0])
    if not n_p or not n_u or not len(hashes):
        return Toxic(np.zeros(0, np.uint64), np.zeros(0), base)
    row = np.repeat(np.arange(n_p + n_u), np.concatenate([p[0], u[0]]))
    column = np.concatenate([p[1], u[1]]).astype(np.int64)
    is_p = np.arange(n_p + n_u) < n_p
    w, b = np.zeros(len(hashes)), base
    m, s = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1)
    for t in range(1, STEPS + 1):
        raw = b + np.bincount(row, w[column], len(is_p))
        like = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        loss_neg = np.logaddexp(0, raw)
        unseen = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
        plus = np.where(is_p, -prior * (1 - like) / n_p, 0)
        minus = np.where(is_p, -prior * like / n_p, like / n_u)
        slope = plus + minus if unseen >= 0 else -minus
        grad = np.append(np.bincount(column, slope[row], len(w)) + DECAY * w / len(is_p), slope.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-10)
        w -= step[:-1]
        b -= step[-1]
    return Toxic(hashes, w, float(b))


def _lists(texts: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many features each text has, and their places; in an order that doesn't depend on tasks."""
    model = Toxic(hashes, np.zeros(len(hashes)), 0.0)

    def run(batches):
        for batch in batches:
            for rows, row, feature in _distinct(batch.column(0), model):
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))], ["x"])

    found = texts.mapInArrow(run, "x array<int>").toArrow()["x"].combine_chunks()
    n = np.diff(found.offsets.to_numpy())
    places = found.flatten().to_numpy()
    start = np.cumsum(n) - n
    sums = np.append(np.uint64(0), np.cumsum(mix(places.astype(np.uint64) + np.uint64(1))))
    order = np.lexsort((n, sums[start + n] - sums[start]))
    at = np.repeat(start[order] - (np.cumsum(n[order]) - n[order]), n[order]) + np.arange(n.sum())
    return n[order], places[at]


def train(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
    prior: float | None = None,
) -> Toxic:
    """Fits on at most `rows` toxic and unlabelled_rows unlabelled texts. Labels of the held-out
    remainder are not read. Texts stay on the executors."""
    if prior is None:
        usable = labels.where((remainder(F.col("doc_id"), modulus) != held_out) & F.col("toxic").isin(0, 1))
        n, toxic = usable.agg(F.count("*"), F.sum("toxic")).head()
        prior = toxic / n if n and toxic else PRIOR
    prior = float(min(max(prior, 0.001), 0.9))
    p = stash(sample(docs, labels, "toxic", modulus, held_out, rows, (1,)).select("text"), "confirmed")
    u = stash(unlabelled(docs, unlabelled_rows), "unlabelled")
    n_p, n_u = p.count(), u.count()
    hashes = choose_features(p, u, n_p, n_u) if n_p and n_u else np.zeros(0, np.uint64)
    model = fit(_lists(p, hashes), _lists(u, hashes), hashes, prior)
    unstash(p)
    unstash(u)
    return model


def score(docs: DataFrame, model: Toxic, out: str = "score") -> DataFrame:
    """All columns of docs and out."""
    return add_scores(docs, model.score, out)
