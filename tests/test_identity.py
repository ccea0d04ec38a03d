"""Identity over time and constrained clusters on written-out observations."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity, kernels, reid
from tidemark.streaming import causal

SEEN = "movie string, seq long, item long, name string, static map<string,string>, allowed array<long>, body array<double>, face array<double>"


def seen(spark, *rows):
    """Observations in order; each is a dict of what is given."""
    names = ("name", "static", "allowed", "body", "face")
    return spark.createDataFrame([(r.get("movie", "m"), i, i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], SEEN)


def assigned(spark, funnel, *rows):
    return [(r.entity, r.is_new, r.score, r.face_score, r.rejected) for r in reid.assign(seen(spark, *rows), ["movie"], funnel).orderBy("item").collect()]


def test_appearance_decides_and_not_the_name(spark):
    plain = reid.Funnel(0.6)
    got = assigned(spark, plain, {"name": "Kite", "body": [3.0, 0.1]}, {"name": "Toy", "body": [2.0, 0.2]}, {"name": "Kite", "body": [0.0, 1.0]})
    assert [(e, new) for e, new, *_ in got] == [(0, True), (0, False), (1, True)] and got[1][2] > 0.99 and got[0][2] is None


def test_static_attributes_and_allowed_entities_gate(spark):
    plain = reid.Funnel(0.6)
    same = [1.0, 0.0]
    got = assigned(
        spark, plain, {"body": same, "static": {"Wood": "Oak"}}, {"body": same, "static": {"wood": "pine"}}, {"body": same, "static": {"size": "big"}}, {"body": same, "static": {"WOOD": "oak", "size": "big"}},
        {"body": same, "allowed": []}, {"body": same, "allowed": [1, 2]},
    )
    assert [(e, new) for e, new, *_ in got] == [(0, True), (1, True), (0, False), (0, False), (2, True), (1, False)]


def test_least_similarity_guard_tells_whom_it_turned_down(spark):
    got = assigned(spark, reid.Funnel(0.55, least=0.85), {"body": [1.0, 0.0]}, {"body": [0.95, 0.3]}, {"body": [0.7, 0.71]}, {"body": [0.7, 0.7]})
    assert [(e, new, r) for e, new, _, _, r in got] == [(0, True, []), (0, False, []), (1, True, [0]), (1, False, [0])]


def test_faces_fuse_rescue_and_never_merge_alone(spark):
    rows = [{"body": [1.0, 0.0], "face": [0.0, 1.0]}, {"body": [0.6, 0.8], "face": [0.1, 1.0]}, {"body": [0.0, 1.0], "face": [0.0, 1.0]}]
    got = assigned(spark, reid.Funnel(0.7, face_strong=0.9, weights={"body": 1.0}), *rows)
    assert [(e, new) for e, new, *_ in got] == [(0, True), (0, False), (1, True)] and got[1][3] > 0.99
    assert reid.fused({"body": 0.8, "face": None, "class": None}, reid.WEIGHTS) == 0.8
    assert reid.fused({"body": 0.4, "face": 0.8}, {"body": 1.0, "face": 1.0}) == pytest.approx(0.6) and reid.fused({"body": None}, {"body": 1.0}) is None


def test_name_decides_without_a_body(spark):
    plain = reid.Funnel(0.6)
    got = assigned(spark, plain, {"name": "Field"}, {"name": " field ", "static": {"sky": "grey"}}, {"name": "Field", "static": {"sky": "blue"}}, {"body": [1.0, 0.0], "name": "Field"}, {"name": None}, {"movie": "other", "name": "Field"})
    assert [(e, new) for e, new, *_ in got] == [(0, True), (0, False), (1, True), (2, True), (3, True), (0, True)]


def test_stream_equals_batch(spark, tmp_path):
    """Observations that arrive file by file meet the galleries that earlier files left."""
    rng = random.Random(8)
    rows = [
        {"movie": rng.choice(["a", "b", None]), "name": rng.choice("xyz"), "static": rng.choice([None, {}, {"k": "1"}, {"k": "2"}]), "body": rng.choice([None, [rng.random(), rng.random() - 0.5, rng.random()]]), "face": rng.choice([None, [rng.random(), 1.0]])}
        for _ in range(160)
    ]
    df = seen(spark, *rows)
    funnel = reid.Funnel(0.9, least=0.7)
    for k in range(4):
        df.where(F.col("seq").between(40 * k, 40 * k + 39)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        stamp = 1_700_000_000 + k
        for path in (tmp_path / "in" / f"p{k}").glob("*.parquet"):
            os.utime(path, (stamp, stamp))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    key = lambda out: sorted(((str(r.movie), r.item, r.entity, r.is_new, r.score, r.face_score, tuple(r.rejected)) for r in out.collect()))
    batch = key(reid.assign(df, ["movie"], funnel))
    assert key(causal.drained(reid.assign_stream(stream, ["movie"], funnel))) == batch
    assert len({(m, e) for m, _, e, *_ in batch}) > 6 and any(r[-1] for r in batch)
    assert key(reid.assign(df.repartition(7), ["movie"], funnel)) == batch


def slow_links(sim, threshold, link="complete"):
    """Best pair first over all pairs of clusters; None counts for nothing, "no" bars."""
    clusters = [[i] for i in range(len(sim))]
    while True:
        best = None
        for a, b in itertools.combinations(sorted(clusters, key=min), 2):
            cross = [sim[min(i, j)][max(i, j)] for i in a for j in b]
            known = [x for x in cross if x is not None]
            if "no" in cross or not known:
                continue
            score = min(known) if link == "complete" else round(sum(known) / len(known), 9)
            if score >= threshold and (best is None or (-score, min(a), min(b)) < best[0]):
                best = ((-score, min(a), min(b)), a, b)
        if best is None:
            return sorted(sorted(c) for c in clusters)
        clusters = [c for c in clusters if c not in best[1:]] + [best[1] + best[2]]


def as_matrix(sim):
    n = len(sim)
    out = np.full((n, n), np.nan)
    for i in range(n):
        for j in range(i + 1, n):
            x = sim[i][j]
            out[i, j] = out[j, i] = np.nan if x is None else -np.inf if x == "no" else x
    return out


def groups(label):
    found = {}
    for i, c in enumerate(label.tolist()):
        found.setdefault(c, []).append(i)
    return sorted(found.values())


@pytest.mark.parametrize("link", ["complete", "average"])
def test_links_by_search(link):
    rng = random.Random(5)
    for trial in range(300):
        n = rng.randint(0, 9)
        values = [0.1, 0.3, 0.5, 0.7, 0.7, 0.9, *([None, "no"] if trial % 2 else [])]
        sim = [[rng.choice(values) for _ in range(n)] for _ in range(n)]
        assert groups(kernels.linked(as_matrix(sim), 0.45, link)) == slow_links(sim, 0.45, link), sim


def test_chains_nulls_and_bars():
    chain = [[1, 0.92, 0.2, 0.1], [0, 1, 0.6, 0.2], [0, 0, 1, 0.88], [0, 0, 0, 1]]
    assert groups(kernels.linked(as_matrix(chain), 0.5)) == [[0, 1], [2, 3]]
    assert groups(kernels.linked(as_matrix([[1, None, 0.8], [0, 1, 0.8], [0, 0, 1]]), 0.5)) == [[0, 1, 2]]
    assert groups(kernels.linked(as_matrix([[1, None], [0, 1]]), 0.5)) == [[0], [1]]
    assert groups(kernels.linked(as_matrix([[1, "no", 0.8], [0, 1, 0.8], [0, 0, 1]]), 0.5)) == [[0, 2], [1]]


def crops(spark, n, seed, labels=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vec = None if i % 17 == 3 else [round(rng.gauss(1, 1), 1) for _ in range(3)]
        static = rng.choice([None, {}, {"Hue": "red"}, {"hue": "RED", "size": "big"}, {"hue": "blue"}])
        rows.append((rng.choice([None, *range(labels)]), i, vec, static))
    return spark.createDataFrame(rows, "label long, item long, vec array<double>, static map<string,string>")


def test_any_size_gives_the_same_clusters(spark):
    """Tasks a key, tasks a component, and rounds of mutual neighbours."""
    key = lambda df: sorted((r.item, r.cluster) for r in df.collect())
    for items, threshold in ((crops(spark, 150, 1), 0.9), (crops(spark, 90, 2).drop("static"), 0.97)):
        whole = key(kernels.link_clusters(items, ["label"], threshold))
        assert whole == key(kernels.link_clusters(items, ["label"], threshold, limit=8))
        assert len({c for _, c in whole}) < 110
    average = kernels.link_clusters(crops(spark, 60, 3), ["label"], 0.9, "average")
    assert average.count() == 60


def test_edges_by_blocks(spark):
    items = crops(spark, 90, 7).drop("static")
    key = lambda df: sorted(map(tuple, df.select("a", "b", "sim").collect()))
    assert key(kernels.similar_edges(items, ["label"], 0.8, block=7)) == key(kernels.similar_edges(items, ["label"], 0.8)) != []


def test_partitions_are_made_total(spark):
    members = spark.createDataFrame([("c", i) for i in range(6)] + [("d", 9)], "cluster string, item long")
    named = spark.createDataFrame([("c", 1, 0, 4), ("c", 1, 1, 2), ("c", 0, 0, 2), ("c", 0, 1, 77), ("c", 2, 0, 5), ("c", 2, 1, 5)], "cluster string, place long, at long, item long")
    got = {(r.cluster, r.item): r.part for r in identity.total_partition(members, named, ["cluster"]).collect()}
    assert got == {("c", 0): 0, ("c", 1): 1, ("c", 2): 2, ("c", 3): 3, ("c", 4): 4, ("c", 5): 5, ("d", 9): 9}
    assert identity.total_partition(members, named.limit(0), ["cluster"]).where("item <> part").count() == 0


SCENE = "kind string, identity_group string, item long, static map<string,string>, vec array<double>, quality double, roster_matched boolean"


def test_large_clusters_are_judged_by_a_sample(spark):
    """Members that were not shown follow their most similar shown one, or the first group without a vector."""
    at = lambda x: [1.0, x]
    rows = [("prop", "g", i, None, at(0.02 * i), 10.0 - i, False) for i in range(6)] + [("prop", "h", 6, None, None, 1.0, True)]
    seen = spark.createDataFrame(rows, SCENE)
    clusters = identity.candidates(seen, 0.9)
    assert {r.item: r.cluster for r in clusters.collect()} == {**dict.fromkeys(range(6), 0), 6: 6}
    shown = identity.shown(seen, clusters, most=2)
    assert {(r.cluster, r.item) for r in shown.collect()} == {(0, 0), (0, 5)}
    verdicts = spark.createDataFrame([(0, False), (6, False)], "cluster long, coherent boolean")
    named = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 5)], "cluster long, place long, at long, item long")
    parts = identity.verified(seen, clusters, shown, verdicts, named)
    assert {r.item: r.part for r in parts.collect()} == {0: 0, 1: 0, 2: 0, 3: 5, 4: 5, 5: 5, 6: 6}
    assert {tuple(r) for r in identity.split_findings(parts).collect()} == {("cluster_split", "prop", 0)}
    whole = identity.verified(seen, clusters, shown, verdicts.limit(0), named)
    assert {tuple(r) for r in identity.split_findings(whole).collect()} == {("large_precluster_sampled", "prop", 0)}


def test_merges_by_a_judge(spark):
    """A contradiction in a group bars the whole of it; clusters beyond the budget are not merged; unmatched groups are told."""
    colour = [{"hue": "red"}, {"HUE": "Red", "size": "s"}, {"hue": "blue"}, None, {"hue": "red"}, {"hue": "green"}]
    rows = [("prop", str(c), 10 * c + k, colour[c] if k == 1 else None, [1.0], 1.0, c == 4) for c in range(6) for k in range(6 - c)]
    seen = spark.createDataFrame(rows, SCENE)
    parts = spark.createDataFrame([(r[0], r[2], r[2] // 10 * 10, r[2] // 10 * 10, False) for r in rows], "kind string, item long, cluster long, part long, sampled boolean")
    facts = identity.cluster_facts(seen, parts)
    assert {r.part: r.n for r in facts.collect()} == {10 * c: 6 - c for c in range(6)} and facts.where("part = 10").first().static == {"hue": "red", "size": "s"}
    named = spark.createDataFrame([("prop", 0, 0, 10), ("prop", 0, 1, 0), ("prop", 1, 0, 20), ("prop", 1, 1, 30), ("prop", 1, 2, 40), ("prop", 2, 0, 50), ("prop", 2, 1, 0)], "kind string, place long, at long, item long")
    final, findings = identity.merged(facts, named, budget=5)
    assert {r.part: r.final for r in final.collect()} == {0: 0, 10: 0, 20: 20, 30: 30, 40: 40, 50: 50}
    assert {(r.code, r.part) for r in findings.collect()} == {
        ("cluster_merged", 0), ("cluster_merged", 10), ("cluster_merge_static_veto", 20), ("cluster_merge_static_veto", 30), ("cluster_merge_static_veto", 40), ("cluster_merge_budget_truncated", 50),
    }
    finals = parts.join(final, ["kind", "part"])
    assert {r.part for r in identity.incomplete(seen, finals).collect()} == {0, 20, 30}
