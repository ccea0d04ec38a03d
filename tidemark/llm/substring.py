"""Substring de-duplication by fixed-block anchors (operator 7).

A repeated window of ``window`` words contains, wherever it stands, one whole
block of ``block`` words that starts at a multiple of ``block`` in the document of
its first occurrence (``window >= 2 * block - 1``).

1. Anchors: hashes of the non-overlapping blocks. Probes: hashes of every rolling
   window of ``block`` words. Both go, as packed arrays, to the bucket of their
   hash; a bucket finds the hashes that are an anchor in one document and are met
   in another, and answers with those each document holds.
2. Extension: in each document, windows around a hit are the only ones that can
   repeat. Each is extended from its hit to all of its words by a fingerprint of two
   independent 64-bit hashes; the smallest doc_id with the same fingerprint is found, and
   neighbouring windows of an earlier document merge into maximal repeats, whose
   words go.

The bucket filter may err on the safe side (short hashes). The second step compares
128-bit fingerprints instead of the words themselves, which would have to be sent for
every hit: it errs if two different windows agree in both hashes.

A bucket holds about ``bucket_size`` probes. Answers are packed by the part of the
documents (a hash of doc_id) they go to, one row for each bucket and part that has any,
and each part unpacks one row a document. What the documents of one task
share is told there, so a passage held by a third of all documents sends one entry
a task; no document is paired with another.

Edge cases: a null or empty text has no words; texts shorter than a window lose
none; of copies, the one of smallest doc_id stays whole; rows that share a doc_id
are judged each by its own text, against documents of smaller doc_id; rows with a null doc_id are
compared with nothing and lose nothing; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, binary, durable, hand_back, mix, window_hashes, word_hashes

WINDOW = 13
BLOCK = 7
BUCKET = 3_000_000
#: Probes that a task gathers before it deals them out.
BATCH = 1_000_000
#: A row: its doc_id, and a hash of its text that tells rows of one doc_id apart.
ROW = np.dtype([("doc", np.int64), ("key", np.int64)])


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _grouped(doc: np.ndarray, *h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by hashes, number of its run for each place in that order, least and greatest doc_id of each run)."""
    order = np.argsort(h[0], kind="stable") if len(h) == 1 else np.lexsort(h[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in h], axis=0)
    starts = np.flatnonzero(new)
    ids = doc[order]
    run = np.cumsum(new) - 1
    return order, run, np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)


def _by_document(doc: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Runs of a document or row (its id, its number of values) and the values."""
    starts = _runs(doc)
    counts = np.diff(np.append(starts, len(doc)))
    return doc[starts].tobytes(), counts.astype(np.uint32).tobytes(), values.tobytes()


PARTS = ["bucket", "ids", "counts", "values", "more"]
PARTS_SCHEMA = "bucket int, ids binary, counts binary, values binary, more binary"


def _told(doc: np.ndarray, values: np.ndarray, buckets: int) -> tuple:
    """A row that needs no answer; it travels with the others, to a bucket beside theirs."""
    first = int(doc["doc"][0] if doc.dtype == ROW else doc[0])
    return buckets + first % buckets, *_by_document(doc, values), None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=PARTS
    )


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _per_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) with the places of a bucket in their order."""
    if not len(h):
        return
    bucket = _bucket(h, buckets)
    order = np.argsort(bucket, kind="stable")
    starts = _runs(bucket[order])
    for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _deal_probes(doc: np.ndarray, place: np.ndarray, h: np.ndarray, block: int, buckets: int) -> pa.RecordBatch:
    """One probe of each hash for its bucket; what two documents of the task share is told at once.

    So a hash that very many documents hold sends one probe a task.
    """
    order, run, least, greatest = _grouped(doc, h)
    anchors = np.zeros(len(least), dtype=bool)
    anchors[run[place[order] % block == 0]] = True
    shared = np.zeros(len(h), dtype=bool)
    shared[order] = (least != greatest)[run]
    rows = []
    if shared.any():
        rows.append(_told(doc[shared], h[shared].astype(np.uint32), buckets))
    first = order[np.concatenate([[True], run[1:] != run[:-1]])]
    flags = np.zeros(len(h), dtype=bool)
    flags[first] = anchors
    first.sort()
    for bucket, at in _per_bucket(h[first], buckets):
        at = first[at]
        rows.append((bucket, *_by_document(doc[at], h[at].astype(np.uint32)), np.packbits(flags[at]).tobytes()))
    return _rows(rows)


def _probes(block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        ids, hashes, waiting = [], [], 0

        def deal() -> pa.RecordBatch:
            doc = np.repeat(np.array(ids, dtype=np.int64), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            return _deal_probes(doc, place, np.concatenate(hashes), block, buckets)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                words = raw.split() if raw else []
                if len(words) < WINDOW:
                    continue
                ids.append(doc)
                hashes.append(window_hashes(word_hashes(words, table), block))
                waiting += len(hashes[-1])
                if waiting >= BATCH:
                    yield deal()
                    ids, hashes, waiting = [], [], 0
        if ids:
            yield deal()
        table.clear()
        del ids, hashes
        hand_back()

    return run


def _joined(rows: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in rows[name]])


def _documents(rows: pd.DataFrame, ids=np.int64) -> np.ndarray:
    return np.repeat(_joined(rows, "ids", ids), _joined(rows, "counts", np.uint32))


def _sorted(ids: np.ndarray, *after: np.ndarray) -> np.ndarray:
    """Order of documents or rows within the order of ``after``."""
    return np.lexsort((ids["key"], ids["doc"], *after) if ids.dtype == ROW else (ids, *after))


PACKED = ["part", "ids", "counts", "values"]
PACKED_SCHEMA = "part int, ids binary, counts binary, values binary"


def _answer(doc: np.ndarray, values: np.ndarray, parts: int) -> pd.DataFrame:
    """A row for each part that the documents (in ascending runs) belong to."""
    ids = np.ascontiguousarray(doc["doc"]) if doc.dtype == ROW else doc
    part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = _sorted(doc, part)
    rows = []
    if len(doc):
        starts = _runs(part[order])
        for at in np.split(order, starts[1:]):
            rows.append((int(part[at[0]]), *_by_document(doc[at], values[at])))
    return pd.DataFrame(rows, columns=PACKED)


def _unpacker(kind: type, ids):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """doc_id (and text_key), found: one row for each document or row of a part."""
        doc, values = _documents(rows, ids), _joined(rows, "values", kind)
        order = _sorted(doc)
        doc, values = doc[order], values[order]
        starts = _runs(doc)
        first = doc[starts]
        names = {"doc_id": first["doc"], "text_key": first["key"]} if ids == ROW else {"doc_id": first}
        return pd.DataFrame(names | {"found": [x.tobytes() for x in np.split(values, starts[1:])]})

    return run


def _answer_probes(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a bucket and the hashes that are an anchor and are met in another document."""
    doc, low = _documents(rows), _joined(rows, "values", np.uint32)
    flags = np.concatenate(
        [np.unpackbits(np.frombuffer(a, np.uint8), count=len(x) // 4) for a, x in zip(rows["more"], rows["values"], strict=True)]
    )
    order, run, least, greatest = _grouped(doc, low)
    anchors = np.zeros(len(least), dtype=bool)
    anchors[run[flags[order] > 0]] = True
    hit = np.zeros(len(low), dtype=bool)
    hit[order] = ((least != greatest) & anchors)[run]
    return doc[hit], low[hit]


def _deal_windows(who: np.ndarray, place: np.ndarray, full: np.ndarray, more: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Windows of each fingerprint's first document in the task for its bucket; later documents lose theirs at once."""
    doc = who["doc"]
    order, run, least, _ = _grouped(doc, full, more)
    late = np.zeros(len(full), dtype=bool)
    late[order] = doc[order] > least[run]
    rows = []
    if late.any():
        rows.append(_told(who[late], place[late], buckets))
    early = np.flatnonzero(~late)
    for bucket, at in _per_bucket(full[early], buckets):
        at = early[at]
        rows.append((bucket, *_by_document(who[at], place[at]), full[at].tobytes() + more[at].tobytes()))
    return _rows(rows)


def _candidates(window: int, block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and full hashes of the windows that hold a hit."""
        table = WordHash()
        found: list[tuple] = []
        waiting = 0
        for batch in batches:
            for doc, key, raw, hits in zip(*(batch.column(k).to_pylist() for k in (0, 1)), binary(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                h = word_hashes(raw.split(), table)
                wanted = np.unique(np.frombuffer(hits, np.uint32))
                low = window_hashes(h, block).astype(np.uint32)
                near = np.concatenate([[0], np.cumsum(np.isin(low, wanted))])
                n = len(h) - window + 1
                span = window - block + 1  # blocks in a window
                place = np.flatnonzero(near[span : span + n] > near[:n]) if n > 0 else np.empty(0, np.int64)
                if len(place):
                    prints = (window_hashes(x, window, seed=1)[place] for x in (h, mix(h)))
                    found.append((np.full(len(place), np.array((doc, key), dtype=ROW)), place.astype(np.int32), *prints))
                    waiting += len(place)
                if waiting >= BATCH:
                    yield _deal_windows(*map(np.concatenate, zip(*found, strict=True)), buckets)
                    found, waiting = [], 0
        if found:
            yield _deal_windows(*map(np.concatenate, zip(*found, strict=True)), buckets)
        del table, found
        hand_back()

    return run


def _answer_windows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the windows of a bucket that also start in a document of smaller doc_id."""
    who, place = _documents(rows, ROW), _joined(rows, "values", np.int32)
    doc = who["doc"]
    prints = [np.split(np.frombuffer(x, np.uint64), 2) for x in rows["more"]]
    full, more = (np.concatenate(x) for x in zip(*prints, strict=True))
    order, run, least, _ = _grouped(doc, full, more)
    late = np.zeros(len(full), dtype=bool)
    late[order] = doc[order] > least[run]
    return who[late], place[late]


def _answers(answer, kind: type, ids, parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        told = rows["more"].isna()
        found = [answer(rows[~told])] if not told.all() else []
        found += [(_documents(rows[told], ids), _joined(rows[told], "values", kind))] if told.any() else []
        return _answer(*map(np.concatenate, zip(*found, strict=True)), parts)

    return run


def _exchange(rows: DataFrame, buckets: int, answer, kind: type, ids=np.int64) -> DataFrame:
    """doc_id (and text_key), found: what the tasks told and what the buckets answer, gathered for each document or row."""
    packed = rows.repartition(2 * buckets, "bucket").groupBy("bucket").applyInPandas(
        _answers(answer, kind, ids, buckets), PACKED_SCHEMA
    )
    names = "doc_id long, text_key long" if ids == ROW else "doc_id long"
    return packed.groupBy("part").applyInPandas(_unpacker(kind, ids), f"{names}, found binary")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, places in zip(binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = raw.split() if raw else []
                n = len(words)
                if places and n >= window:
                    starts = np.unique(np.frombuffer(places, np.int32))
                    depth = np.zeros(n + 1, dtype=np.int32)
                    starts = starts[starts + window <= n]
                    depth[starts] += 1
                    depth[starts + window] -= 1
                    gone = np.cumsum(depth[:-1]) > 0
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                text = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def repeated_windows(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, bucket_size: int = BUCKET) -> DataFrame:
    """doc_id, text_key, found: places (32-bit) in rows of that id and text of windows whose words also start in a document of smaller doc_id."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it stands")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, math.ceil(size / 6 / bucket_size))
    probes = texts.mapInArrow(_probes(block, buckets), PARTS_SCHEMA)
    hits = durable(_exchange(probes, buckets, _answer_probes, np.uint32))
    windows = (
        texts.join(hits.hint("shuffle_hash"), "doc_id")
        .select("doc_id", text_key(), "text", "found")
        .mapInArrow(_candidates(window, block, buckets), PARTS_SCHEMA)
    )
    return durable(_exchange(windows, buckets, _answer_windows, np.int32, ROW))


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, bucket_size: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what is kept, for every row."""
    places = repeated_windows(docs, window, block, bucket_size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")
    return (
        texts.join(places.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
        .select("doc_id", "text", "found")
        .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_substring": op7_substring}
