"""License notices by a positional index of rare words (operator 12).

Templates are indexed by word: a posting is a template and a place in it. How rare a
word is (IDF) is counted over all documents. In each file the licence words are looked up from the rarest
down, and a word is looked up as long as a template in its postings has had fewer than
``DEPTH`` of its words looked up, so every template is met by the rarest of its words that the file holds.

A file's place of a word less its place in the template is an offset. Offsets of
different words that agree within ``SLACK`` words are an alignment; it counts if each
mandatory key phrase of the template stands at its place (within ``SLACK``), and scores
the weight (IDF) of the template's words found at their places in the weight of all. Alignments of
``threshold`` or more give the template's label. Base phrases are key phrases
of their own: each place where they stand is counted, and their labels always stay.

Edge cases: a null or empty text has no words and score 0; texts are read whole; rows are judged each,
so repeated rows give equal rows (and count as documents each in the IDF); further columns are
ignored; an empty table gives no rows; of words equally rare the smaller is looked up first.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary

DEPTH = 3
SLACK = 2
#: Phrases whose places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, mandatory key phrases; all as words in lower case.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "to any person obtaining a copy"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
#: Lower case for A-Z, a blank for every other ASCII character that is no letter or digit; all else stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def consecutive(phrase: list[bytes], words: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
    """Places where a phrase's words stand one after the other, found from its word of fewest places."""
    k = min(range(len(phrase)), key=lambda j: len(places.get(phrase[j], ())))
    starts = (i - k for i in places.get(phrase[k], ()))
    return [s for s in starts if s >= 0 and words[s : s + len(phrase)] == phrase]


def around(sorted_places: list[int], x: int, slack: int) -> int | None:
    """The first place within ``slack`` of ``x``."""
    k = bisect_left(sorted_places, x - slack)
    return sorted_places[k] if k < len(sorted_places) and sorted_places[k] <= x + slack else None


class Index:
    """Postings of the templates' words, weighed by IDF."""

    def __init__(self, templates, base, frequency: dict[bytes, int], n_docs: int):
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (label, notice, keys) in enumerate(templates):
            words = words_of(notice.encode())
            own: dict[bytes, list[int]] = {}
            for j, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, j))
                own.setdefault(w, []).append(j)
            key_places = []
            for key in keys:
                phrase = words_of(key.encode())
                at = consecutive(phrase, words, own)
                if not at:
                    raise ValueError(f"the notice of {label} lacks its key phrase {key!r}")
                key_places.append((tuple(phrase), at))
            self.templates.append((label, words, key_places, {w for phrase, _ in key_places for w in phrase}))
        self.base = [(tuple(words_of(p.encode())), label) for p, label in base]
        self.vocabulary = frozenset(self.postings) | {w for phrase, _ in self.base for w in phrase}
        self.weight = {w: 1 + math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for w in self.vocabulary}

    def lookups(self, present: set[bytes], possible: set[int]) -> dict[int, list[tuple[bytes, int]]]:
        """For each template the postings met, the file's words taken from the rarest down."""
        met: dict[int, list[tuple[bytes, int]]] = {t: [] for t in possible}
        depth = Counter()
        for w in sorted(present & self.postings.keys(), key=lambda w: (-self.weight[w], w)):
            asked = {t for t, _ in self.postings[w] if t in possible and depth[t] < DEPTH}
            for t, j in self.postings[w] if asked else ():
                if t in asked:
                    met[t].append((w, j))
            depth.update(asked)
        return met

    def matches(self, words: list[bytes], threshold: float) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """((place, label) of base phrases, (label, first word, end, score) of verified alignments)."""
        present = self.vocabulary.intersection(words)
        possible = {t for t, (*_, needed) in enumerate(self.templates) if needed <= present}
        phrases = [(p, label) for p, label in self.base if present.issuperset(p)]
        if not possible and not phrases:
            return [], []
        wanted = {w for t in possible for w in self.templates[t][1]}.union(*(p for p, _ in phrases))
        places: dict[bytes, list[int]] = {w: [] for w in wanted & present}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        base = sorted((i, label) for p, label in phrases for i in consecutive(list(p), words, places))
        stand: dict[tuple, list[int]] = {}
        found = set()
        for t, met in self.lookups(present, possible).items():
            label, notice, keys, _ = self.templates[t]
            for phrase, _ in keys:
                if phrase not in stand:
                    stand[phrase] = consecutive(list(phrase), words, places)
            if not all(stand[phrase] for phrase, _ in keys):
                continue
            for offset in alignments(met, places):
                if all(any(around(stand[p], offset + j, SLACK) is not None for j in at) for p, at in keys):
                    at = [around(places.get(w, []), offset + j, SLACK) for j, w in enumerate(notice)]
                    got = sum(self.weight[w] for w, i in zip(notice, at, strict=True) if i is not None)
                    score = got / sum(self.weight[w] for w in notice)
                    if score >= threshold:
                        there = [i for i in at if i is not None]
                        found.add((label, min(there), max(there) + 1, min(1.0, score)))
        return base, sorted(found, key=lambda m: (m[1], m[0], m[2], m[3]))


def alignments(met: list[tuple[bytes, int]], places: dict[bytes, list[int]]) -> list[int]:
    """Offsets on which two different looked-up words agree within ``SLACK`` (one word, if only one was looked up)."""
    offsets = sorted({(i - j, w) for w, j in met for i in places.get(w, ())})
    if len({w for w, _ in met}) < 2:
        return [o for o, _ in offsets]
    out, a = [], 0
    within = Counter()  # words of the offsets from a to b
    b = 0
    for o, w in offsets:
        while b < len(offsets) and offsets[b][0] <= o + SLACK:
            within[offsets[b][1]] += 1
            b += 1
        while offsets[a][0] < o - SLACK:
            within[offsets[a][1]] -= 1
            a += 1
        if (not out or out[-1] != o) and any(n > 0 and x != w for x, n in within.items()):
            out.append(o)
    return out


def _counter(vocabulary: frozenset):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = Counter(), 0
        for batch in batches:
            for raw in binary(batch.column(0)):
                total += 1
                n.update(vocabulary.intersection(words_of(raw)))
        rows = [*n.items(), (b"", total)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64())], names=["word", "n"])

    return count


def word_frequencies(docs: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """Number of documents with each word of the vocabulary, and of all documents under the empty word.

    One row for each word of the vocabulary comes to the driver, whatever the documents.
    """
    counts = docs.select("text").mapInArrow(_counter(vocabulary), "word binary, n long")
    return {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"


def _scanner(index: Index, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
        for batch in batches:
            rows = []
            for raw in binary(batch.column(1)):
                words = words_of(raw)
                base, found = index.matches(words, threshold)
                own = {label for _, label in base}
                labels = own | {m[0] for m in found}
                score = 1.0 if base else max((m[3] for m in found), default=0.0)
                ends = (base[0][0], base[-1][0]) if base else (None, None)
                notices = ",".join(f"{label}:{a}:{b}" for label, a, b, _ in found)
                rows.append((len(words), len(base), *ends, ",".join(sorted(own)), ",".join(sorted(labels)), score, notices))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *(c.split()[0] for c in FOUND.split(", "))]
            )

    return scan


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, threshold: float = 0.6) -> DataFrame:
    """doc_id, base places and labels, all labels, score and the notices (label:first word:end) of every document.

    Two passes over the texts and no shuffle of them: one counts how many documents hold each licence word.
    """
    vocabulary = Index(templates, base, {}, 0).vocabulary
    frequency = word_frequencies(docs, vocabulary)
    index = Index(templates, base, frequency, frequency.get(b"", 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scanner(index, threshold), f"doc_id long, {FOUND}")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_licenses": op12_licenses}
