"""Periodic runs of words by a harmonic grid of common extensions (operator 11).

A run of period ``p`` and at least ``2 * p`` words holds two neighbouring points ``j * p``
and ``(j + 1) * p`` of the grid of ``p``. From each such pair the longest common extension
forward (suffix array) and backward (suffix array of the reversed words) gives the
maximal stretch of period ``p`` around it: ``n / p`` queries a period, ``n log n`` in all.

Texts are taken in batches of about ``BATCH`` words, each with words of its own, so that one suffix
array, one LCP array and one table of range minima serve a whole batch. The suffix array
doubles its prefixes; once they are ``PROBE`` words long, a text in which all of them differ
has no run of the asked length and leaves the batch: in a run of ``least`` words or more
the first ``PROBE`` words stand again one period later.

A stretch found for several periods has the same ends for all of them, and the smallest
is its period (two periods of a word of twice their length have a common divisor as period).

Edge cases: a null, empty or blank text has no words and no runs, and its digests are those of the empty
string; very long texts are batches of their own (about 250 bytes a word); rows are
judged each, so repeated rows give equal rows; further columns are ignored; an empty
table gives no rows; a row without a doc_id is left as it is by ``plant``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, hand_back

LEAST = 24
TIMES = 3
#: Words of a batch, prefix length after which texts without a repeat leave it, and grid queries made at once.
BATCH = 150_000
PROBE = 8
QUERIES_AT_ONCE = 500_000


class Codes(dict):
    """A number for every different word of a batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(rank of each key among the different ones from 1, how many there are)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum())


def _double(rank: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Ranks of prefixes of twice ``width`` words; ``left`` words remain from each place to its text's end."""
    after = np.zeros_like(rank)
    inside = np.flatnonzero(left > width)
    after[inside] = rank[inside + width]
    return _dense(rank * (len(rank) + 1) + after)


def probe(codes: np.ndarray, text: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts with two equal prefixes of at least ``width`` (a power of two) words."""
    rank, n = _dense(text * (int(codes.max(initial=0)) + 1) + codes)
    step = 1
    while step < width and n < len(rank):
        rank, n = _double(rank, left, step)
        step *= 2
    whole = left >= width
    found = np.bincount(rank[whole], minlength=n + 1)[rank] > 1
    return np.unique(text[whole & found])


class Extensions:
    """Longest common extensions of two places of one text: suffix array, LCP array and range minima."""

    def __init__(self, codes: np.ndarray, text: np.ndarray, left: np.ndarray):
        rank, n = _dense(text * (int(codes.max(initial=0)) + 1) + codes)
        step = 1
        while n < len(rank):
            rank, n = _double(rank, left, step)
            step *= 2
        self.rank = (rank - 1).astype(np.int32)
        self.table = self._minima(self._lcp(codes, left))

    def _lcp(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix and the one before it in the array, in the order of places (Kasai et al.)."""
        order = np.empty(len(codes), dtype=np.int64)
        order[self.rank] = np.arange(len(codes))
        before = np.full(len(codes), -1, dtype=np.int64)
        before[order[1:]] = order[:-1]
        lcp = np.zeros(len(codes), dtype=np.int32)
        words, rest, h = codes.tolist(), left.tolist(), 0
        ends = (np.arange(len(left)) + left).tolist()
        for i, j in enumerate(before.tolist()):
            if j < 0 or ends[j] != ends[i]:  # nothing before it in its own text
                h = 0
                continue
            most = min(rest[i], rest[j])
            while h < most and words[i + h] == words[j + h]:
                h += 1
            lcp[self.rank[i]] = h
            if h:
                h -= 1
        return lcp

    @staticmethod
    def _minima(lcp: np.ndarray) -> list[np.ndarray]:
        table, width = [lcp], 1
        while 2 * width <= len(lcp):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` (different places of one text) on."""
        low = np.minimum(self.rank[a], self.rank[b]) + 1
        high = np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of all grid points that have a next one in their text, in portions."""
    texts = np.repeat(np.arange(len(sizes)), sizes // times)
    periods = np.arange(len(texts)) - np.repeat(np.cumsum(sizes // times) - sizes // times, sizes // times) + 1
    points = (sizes[texts] - 1) // np.maximum(periods, 1)
    upto = np.cumsum(points)
    a = 0
    while a < len(texts):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + QUERIES_AT_ONCE, side="right")))
        n = points[a:b]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        t, p = np.repeat(texts[a:b], n), np.repeat(periods[a:b], n)
        yield t, p, starts[t] + j * p
        a = b


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """{number of a text: its runs as (start, length, period) by start, then period}; texts without one are left out.

    A run has ``least`` words and ``times`` periods (two or more) at least.
    """
    if times < 2:
        raise ValueError("the grid finds runs of two periods or more")
    keep = [k for k, t in enumerate(texts) if len(t) >= least]

    def laid(which: list[int]):
        sizes = np.array([len(texts[k]) for k in which], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(int(sizes.sum()))
        return np.concatenate([texts[k] for k in which]).astype(np.int64), np.repeat(np.arange(len(which)), sizes), left, sizes, starts

    width = 1
    while 2 * width <= min(PROBE, least - least // times):  # the first words of a run stand again one period later
        width *= 2
    if keep:
        codes, text, left, *_ = laid(keep)
        keep = [keep[k] for k in probe(codes, text, left, width).tolist()]
    if not keep:
        return {}
    codes, text, left, sizes, starts = laid(keep)
    ahead = Extensions(codes, text, left)
    # The reversed array as a whole: its texts stand in reverse order, a place x becomes total - 1 - x.
    total = len(codes)
    gone = np.arange(total) - starts[text] + 1
    back = Extensions(codes[::-1], (len(keep) - 1 - text)[::-1], gone[::-1])
    found: dict[tuple[int, int, int], int] = {}
    for t, p, x in _grid(sizes, starts, times):
        f = ahead.of(x, x + p)
        b = np.zeros(len(x), dtype=np.int64)
        inner = np.flatnonzero(x > starts[t])
        b[inner] = back.of(total - x[inner], total - x[inner] - p[inner])
        length = p + f + b
        hit = np.flatnonzero((f > 0) & (length >= np.maximum(least, times * p)))
        rows = np.unique(np.stack([t[hit], x[hit] - b[hit], length[hit], p[hit]], axis=1), axis=0)
        for *key, period in reversed(rows.tolist()):  # the smallest period of a stretch comes last
            found[tuple(key)] = min(found.get(tuple(key), period), period)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (t, start, length), p in found.items():
        out.setdefault(keep[t], []).append((start - int(starts[t]), length, p))
    for runs in out.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2] or (run[1] * best[2] == best[1] * run[2] and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside all runs and in the first period of each that no other run takes."""
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, p in runs:
        depth[start + p] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's periodic tails: a tenth of the texts repeat a stretch of theirs from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = strongest(runs)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = collapsed(words, runs) if runs else words
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _scanner(least: int, times: int, planted: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, numbers, waiting = [], [], [], 0
        table = Codes()

        def judged() -> pa.RecordBatch:
            runs = find_runs(numbers, least, times)
            rows = [_row(words, runs.get(k, [])) for k, words in enumerate(texts)]
            types = [pa.int64()] * 5 + [pa.string()] * 2
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *NAMES]
            )

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                words = raw.split() if raw else []
                if planted:
                    words = plant(words, doc)
                ids.append(doc)
                texts.append(words)
                numbers.append(np.fromiter(map(table.__getitem__, words), dtype=np.int32, count=len(words)))
                waiting += len(words) + 1
                if waiting >= BATCH:
                    yield judged()
                    ids, texts, numbers, waiting = [], [], [], 0
                    table.clear()
        if ids:
            yield judged()
        del ids, texts, numbers, table
        hand_back()

    return scan


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, planted: bool = False) -> DataFrame:
    """doc_id, number of runs, the strongest run and the digests of all runs and of the text without their repeats.

    One pass without a shuffle. ``planted`` applies the contract's periodic tails first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scanner(least, times, planted), f"doc_id long, {FOUND}")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True)


QUERIES = {"op11_periodic": op11_periodic}
