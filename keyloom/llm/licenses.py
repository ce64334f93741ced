"""License scans by an exact set-similarity join of text blocks with license templates.

A block for a template is any run of STRETCH times as many consecutive words of a text as the
template has, so a notice is found however its lines are wrapped. A block matches if it holds at
least THRESHOLD of the template's distinct words, among them those that tell the licence. Template
words are ordered by how many texts of the whole corpus hold them, rare ones first. A matching block
holds one of the first |T| - need + 1 of them (prefix and positional filter: after a later one too
few are left), and lies in a text of at least `need` words (length filter), so only the surroundings
of such words are looked at. What remains is counted exactly, so every matching block is found. Of
matching blocks that overlap, the first of those that hold most is reported.

A null text is an empty text: no words, no places, empty labels, score 0. Rows with null or
repeated doc_id are rows like any other; an empty table gives no rows. Words equally frequent are
ordered by themselves. Other columns are not looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import ALNUM, Words, text_chunks

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Sentences that licenses are known by, in words of lower case: (label, words, words
# that a notice must hold).
TEMPLATES = [
    ("agpl", "gnu affero general public license as published by the free software foundation", "affero"),
    ("agpl", "spdx license identifier agpl 3 0", "spdx agpl"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license", ""),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ""),
    ("apache", "spdx license identifier apache 2 0", "spdx apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ""),
    ("bsd", "spdx license identifier bsd 3 clause", "spdx bsd"),
    ("bsd", "licensed under the bsd license", "bsd"),
    ("cc", "licensed under a creative commons attribution license", "creative commons"),
    ("cc", "licensed under cc by 4 0", "cc"),
    ("cc", "licensed under cc by sa 4 0", "cc"),
    ("cc", "licensed under cc by nc 4 0", "cc"),
    ("cc0", "waived all copyright and related or neighboring rights to this work", "waived neighboring"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse"),
    ("gpl", "licensed under the gnu general public license", ""),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ""),
    ("gpl", "spdx license identifier gpl 2 0", "spdx gpl"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted", ""),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser"),
    ("lgpl", "spdx license identifier lgpl 2 1", "spdx lgpl"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ""),
    ("mit", "spdx license identifier mit", "spdx mit"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    ("mpl", "spdx license identifier mpl 2 0", "spdx mpl"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ""),
]
THRESHOLD = (8, 10)
#: Words of a block, as a multiple of the template's.
STRETCH = 2


class Vocabulary:
    """Words of templates and phrases by hash; which template has which word; need: the distinct words
    that a block must hold; spans: the words of a block."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD):
        self.sets = [sorted(set(t.split())) for _, t, _ in templates]
        self.spans = [STRETCH * len(t.split()) for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.words = sorted({w for s in self.sets for w in s} | {w for p, _ in self.phrases for w in p})
        raw = "\n".join(self.words).encode()
        hashes = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hashes()
        assert len(self.words) == len(hashes)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        place = {w: i for i, w in enumerate(self.words)}
        self.has = np.zeros((len(self.words), len(self.sets)), bool)
        self.telling = np.zeros_like(self.has)
        for t, s in enumerate(self.sets):
            self.has[[place[w] for w in s], t] = True
            self.telling[[place[w] for w in templates[t][2].split()], t] = True
        assert (self.has >= self.telling).all()
        self.size = self.has.sum(0)
        self.need = -(-threshold[0] * self.size // threshold[1])

    def ids(self, words: Words) -> np.ndarray:
        """The place of each word in self.words, or -1."""
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def prefixes(self, counts: np.ndarray) -> np.ndarray:
        """Which words are in the prefix of which template, given how many texts hold each word."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        out = np.zeros_like(self.has)
        for t in range(len(self.sets)):
            own = np.flatnonzero(self.has[:, t])
            out[own[np.argsort(rank[own])][: self.size[t] - self.need[t] + 1], t] = True
        return out


def word_counts(docs: DataFrame, v: Vocabulary) -> np.ndarray:
    """How many texts of the corpus hold each word of the vocabulary."""

    def count(batches):
        total = np.zeros(len(v.words), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets, ALNUM)
                ids = v.ids(words)
                some = ids >= 0
                held = np.unique(words.doc[some] * len(total) + ids[some]) % len(total)
                total += np.bincount(held, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word long, n long")
    total = np.zeros(len(v.words), np.int64)
    for word, n in parts.groupBy("word").agg(F.sum("n")).collect():  # a row for each vocabulary word
        total[word] = n
    return total


def notices(words: Words, ids: np.ndarray, v: Vocabulary, prefix: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, distinct words held) of the matching blocks of a run of texts."""
    hit = np.flatnonzero(ids >= 0)
    kind, out = ids[hit], []
    for t, (span, need) in enumerate(zip(v.spans, v.need)):
        rare = hit[prefix[kind, t]]
        if not len(rare):
            continue
        mine = v.has[kind, t]
        at, of = hit[mine], kind[mine]
        after = np.searchsorted(rare, at)
        near = (rare[np.minimum(after, len(rare) - 1)] - at < span) & (after < len(rare))
        near |= (at - rare[np.maximum(after - 1, 0)] < span) & (after > 0)
        begin = words.of[words.doc[at]]
        near &= words.of[words.doc[at] + 1] - begin >= need
        at, of, begin = at[near], of[near], np.maximum(begin[near], at[near] - span + 1)
        if len(at) < need:
            continue
        own = np.flatnonzero(v.has[:, t])
        last = np.stack([np.maximum.accumulate(np.where(of == w, at, -1)) for w in own])
        inside = last >= begin
        told = inside[v.telling[own, t]].all(0)
        held, first = inside.sum(0), np.where(inside, last, len(ids)).min(0)
        kept: list[tuple[int, int, int, int]] = []
        for i in np.flatnonzero(told & (held >= need)):
            if not kept or first[i] > kept[-1][2]:
                kept.append((t, int(first[i]), int(at[i]), int(held[i])))
            elif held[i] > kept[-1][3]:
                kept[-1] = (t, int(first[i]), int(at[i]), int(held[i]))
        out += kept
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, places array<struct<label, word>> of the phrases,
    notices array<struct<label, template, word, words, containment>> of the templates: first word and
    number of words, counted from 0 within the text."""
    v = Vocabulary(templates, phrases, threshold)
    prefix = v.prefixes(word_counts(docs, v))
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    notice = pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                ids = v.ids(words)
                places: list[list] = [[] for _ in range(last - first)]
                found: list[list] = [[] for _ in range(last - first)]
                for phrase, label in v.phrases:
                    k = len(phrase)
                    if len(ids) < k:
                        continue
                    here = words.doc[: len(ids) - k + 1] == words.doc[k - 1 :]
                    for j, w in enumerate(phrase):
                        here &= ids[j : len(ids) - k + 1 + j] == v.words.index(w)
                    for i in np.flatnonzero(here):
                        d = words.doc[i]
                        places[d].append({"label": label, "word": int(i - words.of[d])})
                for t, begin, end, n in notices(words, ids, v, prefix):
                    d = words.doc[begin]
                    found[d].append({
                        "label": v.labels[t], "template": t, "word": int(begin - words.of[d]), "words": end - begin + 1,
                        "containment": float(n / v.size[t]),
                    })
                columns = [batch.column(0).slice(first, last - first), pa.array(np.diff(words.of))]
                columns += [pa.array(places, pa.list_(place)), pa.array(found, pa.list_(notice))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "notices"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run,
        "doc_id long, n_words long, places array<struct<label:string,word:long>>, "
        "notices array<struct<label:string,template:int,word:long,words:long,containment:double>>",
    )
