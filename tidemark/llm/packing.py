"""Packing token sequences by non-negative least squares (operator 10).

Each task walks its partition once: it tokenizes whole documents, and whenever
``buffer_tokens`` ids are waiting it packs them. Full windows are cut off long
documents; the lengths that remain form a histogram over classes of ``GRID``-th
parts of the window. Shallow combinations (at most two classes, each repeated)
that fill the window are enumerated, their repeat counts are solved against the
histogram by non-negative least squares and rounded down, and pieces are dealt
to the combinations. The residual pieces first fill the small gaps left by
classes (cut where the gap ends) and are then packed greedily into windows. What
is left below one window moves on to the next buffer; at a partition's end it is
cut into power-of-two lengths, which need no padding.

Nothing is shuffled and a task holds one buffer, so cost grows with the input
and a lost task is simply run again.

Edge cases: a null or empty text is one id (the end id); repeated rows are
packed each; a text of any length is cut into windows; further columns are
ignored; an empty table gives no rows. Sequence ids are unique: the partition's
number in the high bits, a counter below.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import binary, hand_back

WINDOW = 4096
GRID = 64
END_ID = 2
SCHEMA = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class WordTokens:
    """Ids (as bytes) of a text's words, cut at ASCII white space.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its words in order. ASCII punctuation after letters and digits
    is a token of its own, so the two parts are looked up apart. Common words are
    remembered, ``limit`` at most.
    """

    limit = 500_000
    marks = ".,;:!?|"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _split(self, word: bytes) -> tuple[str, str]:
        text = word.decode("utf-8", "replace")
        core = text.rstrip(self.marks)
        if core.isascii() and core.isalnum():
            return core.lower(), text[len(core) :]
        return text, ""

    def encode(self, raw: bytes) -> np.ndarray:
        words = raw.split()
        ids = list(map(self.words.get, words))
        if None in ids:
            fresh = {w: self._split(w) for w, x in zip(words, ids, strict=True) if x is None}
            known = self.parts
            items = [x for x in {y for pair in fresh.values() for y in pair} if x not in known]
            found = self.model.encode_batch_fast(items, add_special_tokens=False)
            new = {x: np.array(e.ids, dtype="<u4").tobytes() for x, e in zip(items, found, strict=True)}
            if len(known) < self.limit:
                known.update(new)
            part = lambda x: new[x] if x in new else known[x]
            made = {w: part(a) + part(b) for w, (a, b) in fresh.items()}
            if len(self.words) < self.limit:
                self.words.update(made)
            ids = [made[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return np.frombuffer(b"".join(ids), dtype="<u4")


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, whatever the number of tasks it runs."""
    return WordTokens(path)


@lru_cache(maxsize=4)
def combinations(grid: int = GRID) -> np.ndarray:
    """Columns: how often each class (1..grid) is used; every column sums to ``grid`` units."""
    found = set()
    for a in range(1, grid + 1):
        for k in range(1, grid // a + 1):
            left = grid - k * a
            if not left:
                found.add(((a, k),))
            for b in range(a + 1, left + 1):
                if left % b == 0:
                    found.add(((a, k), (b, left // b)))
    out = np.zeros((grid, len(found)))
    for j, combo in enumerate(sorted(found)):
        for c, k in combo:
            out[c - 1, j] = k
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-7 * scale or len(active) >= a.shape[0]:
            break
        active.append(j)
        while active:
            s = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[active] = s
                break
            now = x[active]
            low = s <= 0
            step = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            now = now + step * (s - now)
            x[:] = 0
            x[active] = np.maximum(now, 0)
            active = [c for c, v in zip(active, now, strict=True) if v > 1e-9 * scale]
    return x


def plan_counts(histogram: np.ndarray, grid: int = GRID) -> list[tuple[np.ndarray, int]]:
    """(combination, repeats): rounded down, and never more of a class than there is."""
    shapes = combinations(grid)
    x = nnls(shapes, histogram.astype(float))
    left = histogram.astype(np.int64).copy()
    out = []
    for j in np.argsort(-x):
        if x[j] < 1:
            break
        need = shapes[:, j].astype(np.int64)
        used = need > 0
        n = int(min(np.floor(x[j]), (left[used] // need[used]).min()))
        if n > 0:
            out.append((need, n))
            left -= n * need
    return out


Piece = tuple[int, int, int]  # index of the document in the buffer, start, length


def pack_pieces(pieces: list[Piece], window: int = WINDOW, grid: int = GRID) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces, each ``window`` long or nearly so, and the pieces left (less than a window)."""
    unit = window // grid
    classes: list[list[Piece]] = [[] for _ in range(grid + 1)]
    for p in pieces:
        classes[-(-p[2] // unit)].append(p)
    sequences: list[list[Piece]] = []
    for need, n in plan_counts(np.array([len(c) for c in classes[1:]]), grid):
        used = [(c + 1, int(k)) for c, k in enumerate(need) if k]
        for _ in range(n):
            sequences.append([classes[c].pop() for c, k in used for _ in range(k)])
    residual = [p for c in classes for p in c]
    room = sum(p[2] for p in residual)
    gaps = [window - sum(p[2] for p in s) for s in sequences]
    lacking = sum(gaps)
    while sequences and room < lacking:  # give a sequence up to fill the others' gaps
        lacking -= gaps.pop()
        back = sequences.pop()
        room += sum(p[2] for p in back)
        residual += back
    residual.sort(key=lambda p: p[2])  # long pieces go first
    for s, gap in zip(sequences, gaps, strict=True):
        while gap:
            doc, start, length = residual.pop()
            take = min(gap, length)
            s.append((doc, start, take))
            gap -= take
            if take < length:
                residual.append((doc, start + take, length - take))
    left = sum(p[2] for p in residual)
    while left >= window:  # the longest are at the end
        filled, got = [], 0
        while got < window:
            doc, start, length = residual.pop()
            take = min(window - got, length)
            filled.append((doc, start, take))
            got += take
            if take < length:
                residual.append((doc, start + take, length - take))
        left -= window
        sequences.append(filled)
    residual.reverse()
    return sequences, residual


def _powers(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """The rest of a partition in sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    pieces = list(reversed(pieces))
    out = []
    size = window
    while total:
        if size > total:
            size //= 2
            continue
        filled, got = [], 0
        while got < size:
            doc, start, length = pieces.pop()
            take = min(size - got, length)
            filled.append((doc, start, take))
            got += take
            if take < length:
                pieces.append((doc, start + take, length - take))
        out.append(filled)
        total -= size
    return out


def _packer(path: str, window: int, grid: int, buffer_tokens: int, id_type: pa.DataType):
    def rows(docs: list, sequences: list[list[Piece]], base: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(7)]
        for k, sequence in enumerate(sequences):
            offset = 0
            for index, start, length in sequence:
                doc_id, ids = docs[index]
                value = zlib.crc32(ids[start : start + length].tobytes())
                for c, v in zip(columns, (doc_id, start, length, value, len(ids), base + k, offset), strict=True):
                    c.append(v)
                offset += length
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=[p.split()[0] for p in SCHEMA.split(", ")],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        next_id = TaskContext.get().partitionId() << 40
        docs: list = []
        pieces: list[Piece] = []
        full: list[list[Piece]] = []
        waiting = 0
        tail = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                ids = np.concatenate([tokens.encode(raw or b""), tail])
                docs.append((doc_id, ids))
                k = len(docs) - 1
                whole = len(ids) // window
                full += [[(k, j * window, window)] for j in range(whole)]
                if len(ids) % window:
                    pieces.append((k, whole * window, len(ids) % window))
                waiting += len(ids)
                if waiting >= buffer_tokens:
                    made, pieces = pack_pieces(pieces, window, grid)
                    yield rows(docs, full + made, next_id)
                    next_id += len(full) + len(made)
                    docs, pieces = _carry(docs, pieces)
                    full, waiting = [], sum(p[2] for p in pieces)
        made, pieces = pack_pieces(pieces, window, grid)
        yield rows(docs, full + made + _powers(pieces, window), next_id)
        docs = pieces = full = made = batch = ids = None
        hand_back()

    return pack


def _carry(docs: list, pieces: list[Piece]) -> tuple[list, list[Piece]]:
    """Only the documents that pieces still refer to."""
    keep = {k: n for n, k in enumerate(dict.fromkeys(p[0] for p in pieces))}
    return [docs[k] for k in keep], [(keep[k], s, n) for k, s, n in pieces]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    grid: int = GRID,
    buffer_tokens: int = 1 << 21,
) -> DataFrame:
    """One row for each piece of each document: where it starts, and its sequence and offset there."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)["doc_id"]
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    pack = _packer(tokenizer_path, window, grid, buffer_tokens, id_type)
    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA.format(id=kind))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_packing": op10_packing}
