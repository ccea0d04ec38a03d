"""Pairs of one key compared in blocks, against every pair compared by itself."""

import numpy as np
import pytest

from tidemark.operators import similarity

KEYS = ["k"]


@pytest.fixture(scope="module")
def drawn():
    x = np.random.default_rng(5).normal(size=(60, 4)).round(3)
    x[7] = 0
    return [(i % 2 if i < 58 else 2 + i, i, i % 3, x[i].tolist()) for i in range(60)] + [(0, 60, 0, None)]


@pytest.fixture(scope="module")
def rows(spark, drawn):
    return spark.createDataFrame(drawn, "k int, item long, side int, vec array<double>")


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / size), 6) if size else 0.0


def every_pair(drawn):
    return [(k, i, j, cosine(a, b)) for k, i, _, a in drawn for m, j, _, b in drawn if k == m and i < j and a and b]


def in_blocks(df):
    """Pairs are compared where two blocks meet; none is a row of a join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "zip_with" not in plan
    return df.collect()


@pytest.mark.parametrize("block", [7, 4096])
def test_pairs_at_a_threshold(rows, drawn, block):
    """F8"""
    got = sorted(tuple(r) for r in in_blocks(similarity.pairs_within(rows, KEYS, "item", "vec", 0.3, block)))
    assert got == sorted(p for p in every_pair(drawn) if p[3] >= 0.3)


def test_least_pair(rows, drawn):
    """F6"""
    got = {r.k: (r.n, r.dispersion) for r in in_blocks(similarity.dispersion(rows, KEYS, "item", "vec"))}
    pairs = every_pair(drawn)
    assert got == {k: (sum(d[0] == k for d in drawn), min((p[3] for p in pairs if p[0] == k), default=None)) for k in {d[0] for d in drawn}}


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_earlier_item(rows, drawn, block):
    """F7"""
    best = {}
    for _, _, j, s in every_pair(drawn):
        best[j] = max(s, best.get(j, -2))
    assert {r.item: r.sim for r in in_blocks(similarity.nearest_earlier(rows, KEYS, "item", "vec", block))} == best


@pytest.mark.parametrize("block", [7, 4096])
def test_best_between_sides(rows, drawn, block):
    """F19"""
    found = {}
    for k, _, p, a in drawn:
        for m, _, q, b in drawn:
            if k == m and p < q and a and b:
                found.setdefault((k, p, q), []).append(round(float(np.dot(a, b)), 6))
    got = in_blocks(similarity.best_between(rows, KEYS, "side", "vec", "item", block))
    assert {(r.k, r.side_a, r.side_b): (r.best, r.n) for r in got} == {x: (max(v), len(v)) for x, v in found.items()}
