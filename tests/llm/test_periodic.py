"""Periodic runs against a search that compares every word with the one a period before."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least, times):
    found = {}
    n = len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, times * p):
                found.setdefault((start, length), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def slow_plant(words, doc_id):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def slow_row(text, doc_id):
    words = slow_plant(WORD.findall(text or ""), doc_id)
    runs = slow_runs(words, 24, 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def coded(words):
    table = {}
    return np.array([table.setdefault(w, len(table)) for w in words], dtype=np.int32)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=70), max_size=5), st.sampled_from([(2, 2), (6, 2), (6, 3), (24, 3), (9, 4)]))
def test_runs_of_any_words(texts, shape):
    found = periodic.find_runs([coded(t) for t in texts], *shape)
    assert [found.get(k, []) for k in range(len(texts))] == [slow_runs(t, *shape) for t in texts]


def test_nested_and_long_runs():
    """Runs in runs, one after the other, over a whole text, and two that share words."""
    inner = list("xyxyxyxyxyxyxyxyxyxyxyxyz")
    texts = [inner * 4, ["a"] * 5000, list("abcdefgh") * 3, list("ab") * 12 + list("cd") * 12, (list("abcab") * 9)[:40], [f"w{i}" for i in range(500)]]
    texts.append([f"w{i % 97}" for i in range(2000)])
    found = periodic.find_runs([coded(t) for t in texts])
    assert [found.get(k, []) for k in range(len(texts))] == [slow_runs(t, 24, 3) for t in texts]
    assert found[1] == [(0, 5000, 1)] and 5 not in found and found[6] == [(0, 2000, 97)]


def test_grid_in_portions(monkeypatch):
    rng = random.Random(4)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 90))] for _ in range(30)]
    monkeypatch.setattr(periodic, "QUERIES_AT_ONCE", 50)
    found = periodic.find_runs([coded(t) for t in texts], 4, 2)
    assert [found.get(k, []) for k in range(len(texts))] == [slow_runs(t, 4, 2) for t in texts]


def test_ties_of_the_strongest_run():
    assert periodic.strongest([(0, 30, 10), (40, 24, 8), (70, 24, 8)]) == (0, 30, 10)
    assert periodic.strongest([(5, 24, 8), (5, 30, 10)]) == (5, 24, 8)
    assert periodic.strongest([(0, 24, 8), (30, 25, 8)]) == (30, 25, 8) and periodic.strongest([]) is None


def test_edge_cases(spark, edge_docs, no_docs, monkeypatch):
    for size in (150_000, 100):
        monkeypatch.setattr(periodic, "BATCH", size)
        got = [tuple(r) for r in periodic.periodic_runs(edge_docs, planted=True).collect()]
        assert sorted(got, key=repr) == sorted((slow_row(r.text, r.doc_id) for r in edge_docs.collect()), key=repr)
    assert periodic.periodic_runs(no_docs).count() == 0


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in periodic.op11_periodic(spark, sf).collect())
    assert got == sorted(slow_row(r.text, r.doc_id) for r in docs)
    assert sum(r[1] > 0 for r in got) > len(got) / 20
