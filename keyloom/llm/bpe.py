"""Byte-level BPE by batched numpy merge rounds, and its inverse.

The symbols of all new words of a batch are in one flat array. Each round finds the rank of every
adjacent pair by binary search over the sorted pair keys, merges the lowest-ranked pair of each
word wherever it stands (from the left, without overlap), and lets go of words without a mergeable
pair. Words already met keep their ids in a store of bounded size. Texts are never cut: a word
is what the vocabulary's own pattern splits off.

A null text is an empty text: no ids, decoded to the empty string. Rows with null or repeated
doc_id are rows like any other. Other columns are not looked at."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import CHUNK, text_chunks

#: How byte-level vocabularies of this kind split text before any merge (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Symbols in the store of known words; when more, it starts anew.
STORE = 4_000_000
#: Bytes of text at once: the words of one chunk are Python strings.
TEXT = CHUNK // 2


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        chars = byte_characters()
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        byte_of = {c: b for b, c in enumerate(chars)}
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.split = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.word_ids: list[np.ndarray] = []
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for token, i in self.special.items():
            self.known[f"\0special {token}"] = len(self.at) - 1
            self.flat = np.append(self.flat, np.int32(i))
            self.at = np.append(self.at, len(self.flat))

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each)."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            key[word[:-1] != word[1:]] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], len(self.keys)), len(self.keys))
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            active = best < len(self.keys)
            done.append((symbols[~active], word[~active]))
            take = np.flatnonzero(active & (rank == best))
            if len(take):  # of overlapping places, every other one from the left
                run = np.append(True, np.diff(take) != 1)
                start = np.flatnonzero(run)
                nth = np.arange(len(take)) - np.repeat(start, np.diff(np.append(start, len(take))))
                take = take[nth % 2 == 0]
                symbols[take] = self.merged[at[take]]
                active[take + 1] = False
            symbols, word = symbols[active], word[active]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def words(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.split.findall(text)
        out, begin = [], 0
        for m in self.specials.finditer(text):
            out += self.split.findall(text[begin : m.start()])
            out.append(f"\0special {m[0]}")
            begin = m.end()
        return out + self.split.findall(text[begin:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (int32) of each text."""
        if len(self.flat) > STORE:
            self._forget()
        split = [self.words(t) for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        if new:
            ids, counts = self.merge_rounds([w.encode("utf-8", "surrogatepass") for w in new])
            self.known.update(zip(new, range(len(self.at) - 1, len(self.at) - 1 + len(new))))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, ids])
        out = []
        for words in split:
            w = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            out.append(gather(self.flat, self.at[w], self.at[w + 1] - self.at[w]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = gather(self.bytes, self.begins[ids], self.lengths[ids])
        return raw.tobytes().decode("utf-8", "replace")


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + length[i]] for all i, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin - ends + length, length)]


_LOADED: dict[str, Bpe] = {}


def tokenize(docs: DataFrame, path: str, keep: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """The keep columns (default: doc_id) of every row with ids (array<int>) of its whole text and,
    with decoded, the text that those ids decode to. path: the vocabulary file, on each machine."""
    keep = ["doc_id"] if keep is None else keep
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>"] + ["decoded string"] * decoded)
    names = [f.name for f in fields]

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = Bpe(path)
        bpe = _LOADED[path]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last, _, _ in text_chunks(texts, TEXT):
                ids = bpe.encode(texts.slice(first, last - first).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = pa.array(np.concatenate(ids))
                columns = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids", *["decoded"] * decoded])

    columns = [F.col(f"`{c}`") for c in names]
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text_to_encode")).mapInArrow(run, schema)
