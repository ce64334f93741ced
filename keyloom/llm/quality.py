"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round each feature in turn gets a shallow tree of the present
residuals, added to that feature's lookup table of bins; then the pairs of features with the
strongest leftover signal get two-dimensional tables in the same way. A text's score is the
logistic of the sum of its bins' entries. Features are statistics of the whole text; id, source,
language and labels are no features.

Training uses at most `rows` labelled rows of each class (a documented bound); scoring streams
over all rows with one small table. A null text is an empty text. Without usable labels every
score is 0.5. Rows with null ids are scored and are not held out. Repeated rows get equal scores; a
repeated label row counts as one more example. Features of equal gain are tried in their order. An
empty table trains on nothing and gives no rows. The score column replaces one of the same name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.labelled import remainder, sample
from keyloom.llm.shared import LOWER, NOT_SPACE, Words, byte_class, text_chunks

TRAIN_ROWS = 6_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 40, 20, 6, 0.2
FEATURES = [
    "bytes", "words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "stops", "commas", "lines",
    "distinct_words", "capitalised", "bare", "odd_ends", "shouted_words", "short_words", "distinct_lines", "high_bytes",
]
_LETTER = byte_class(b"abcdefghijklmnopqrstuvwxyz")
_SYMBOL = byte_class(b"#$%&*+/<=>@\\^_`{}~[]", False)
_SHOUT = byte_class(b"!?", False)


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(sums[offsets])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a run."""
    n = np.diff(offsets)
    words = Words(data, offsets, NOT_SPACE)
    n_words = np.diff(words.of)
    per_word, per_byte = np.maximum(n_words, 1), np.maximum(n, 1)
    upper = (data >= 65) & (data <= 90)
    lower = _LETTER[data]
    ups = np.concatenate([[0], np.cumsum(upper)])
    lows = np.concatenate([[0], np.cumsum(lower)])
    w_up, w_low = ups[words.end] - ups[words.start], lows[words.end] - lows[words.start]
    w_len = words.end - words.start

    def by_word(flags):
        return np.bincount(words.doc, weights=flags, minlength=len(n)) / per_word

    hashes = words.hashes()
    order = np.lexsort((hashes, words.doc))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc[order][fresh], minlength=len(n)) / per_word
    lines = Words(data, offsets, ~byte_class(b"\n", False))
    n_lines = np.maximum(np.diff(lines.of), 1)
    lh = lines.hashes()
    order = np.lexsort((lh, lines.doc))
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[order][1:] != lh[order][:-1]) | (lines.doc[order][1:] != lines.doc[order][:-1])
    last = data[words.end - 1] if len(data) else np.zeros(0, np.uint8)
    ordinary_end = _LETTER[LOWER[last]] | byte_class(b"0123456789.,;:", False)[last]
    return np.stack(
        [
            np.log1p(n), np.log1p(n_words), np.bincount(words.doc, weights=w_len, minlength=len(n)) / per_word,
            _within(upper, offsets) / np.maximum(_within(upper | lower, offsets), 1),
            _within((data >= 48) & (data <= 57), offsets) / per_byte, _within(_SYMBOL[data], offsets) / per_word,
            _within(_SHOUT[data], offsets) / per_word, _within(data == 124, offsets) / per_word,
            _within(data == 46, offsets) / per_word, _within(data == 44, offsets) / per_word,
            _within(data == 10, offsets) / per_word, distinct, by_word(upper[words.start]),
            by_word(w_up + w_low == 0), by_word(~ordinary_end), by_word((w_low == 0) & (w_up > 0)), by_word(w_len <= 2),
            np.bincount(lines.doc[order][fresh], minlength=len(n)) / n_lines, _within(data >= 128, offsets) / per_byte,
        ],
        1,
    )


def feature_rows(texts: list[str]) -> np.ndarray:
    parts = [features(d, o) for _, _, d, o in text_chunks(pa.array(texts, pa.string()))]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _tree(gain_g: np.ndarray, gain_h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Steps of a shallow tree over ordered bins with sums of gradients and hessians."""
    total_g, total_h = gain_g.sum(), gain_h.sum()
    step = np.full(len(gain_g), total_g / (total_h + 1.0))
    if depth and len(gain_g) > 1:
        g, h = np.cumsum(gain_g)[:-1], np.cumsum(gain_h)[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > total_g**2 / (total_h + 1) + 1e-9:
            step = np.concatenate([_tree(gain_g[:cut], gain_h[:cut], depth - 1), _tree(gain_g[cut:], gain_h[cut:], depth - 1)])
    return step


class Gam:
    """intercept, cuts and tables of single features, (i, j, table) of pairs."""

    def __init__(self):
        self.intercept, self.cuts, self.tables, self.pairs = 0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Gam":
        self = cls()
        if not len(y) or y.min() == y.max():
            self.intercept = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return self
        self.intercept = float(np.log(y.mean() / (1 - y.mean())))
        self.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        b = self.bins(x)
        sizes = [len(c) + 1 for c in self.cuts]
        self.tables = [np.zeros(s) for s in sizes]
        at = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, s in enumerate(sizes):
                p = 1 / (1 + np.exp(-at))
                step = RATE * np.clip(_tree(np.bincount(b[:, f], y - p, s), np.bincount(b[:, f], p * (1 - p), s)), -4, 4)
                self.tables[f] += step
                at += step[b[:, f]]
        p = 1 / (1 + np.exp(-at))
        strength = []
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes)):
                cell = (b[:, i] * 6 // sizes[i]) * 6 + b[:, j] * 6 // sizes[j]
                g, h = np.bincount(cell, y - p, 36), np.bincount(cell, p * (1 - p), 36)
                strength.append((float((g**2 / (h + 1)).sum()), i, j))
        for _, i, j in sorted(strength, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, np.zeros((sizes[i], sizes[j]))))
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-at))
                cell = b[:, i] * sizes[j] + b[:, j]
                g = np.bincount(cell, y - p, table.size).reshape(table.shape)
                h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                halves = _tree(g.sum(1), h.sum(1), 1)  # one cut of i, then trees of j on each side
                side = np.concatenate([[0], np.cumsum(np.diff(halves) != 0)]).astype(int)
                step = np.zeros_like(table)
                for part in range(side[-1] + 1):
                    step[side == part] = RATE * np.clip(_tree(g[side == part].sum(0), h[side == part].sum(0)), -4, 4)
                table += step
                at += step[b[:, i], b[:, j]]
        return self


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> Gam:
    """Fits on at most `rows` rows of each class outside the held-out remainder. Features are made
    on the executors; the driver gets at most 2 * rows short rows."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(0)):
                x = features(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([flat, batch.column(1).slice(first, last - first)], ["x", "y"])

    got = sample(docs, labels, "quality", modulus, held_out, rows).mapInArrow(run, "x array<double>, y int").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))  # the same fit whatever the order of arrival
    return Gam.fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Gam, out: str = "score") -> DataFrame:
    """All columns of docs and out, which replaces a column of that name."""
    return add_scores(docs, lambda data, offsets: model.score(features(data, offsets)), out)


def add_scores(docs: DataFrame, scorer, out: str) -> DataFrame:
    """docs and a column of scorer(bytes, offsets) of each run of whole texts. Only text goes to
    Python; nulls are empty texts."""
    from pyspark.sql.functions import arrow_udf

    def run(texts: pa.Array) -> pa.Array:
        parts = [scorer(data, offsets) for _, _, data, offsets in text_chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, arrow_udf(run, "double")(F.coalesce(F.col("text"), F.lit(""))))


def held_out(doc_id: Column, modulus: int = 3, of: int = 1) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == of, F.lit(False))
