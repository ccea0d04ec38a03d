"""Kernels, components, joins, sources and streams against hand-made or brute-force answers."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as VEC
from tidemark.operators import graph, joins, kernels, rules, similarity, timeline
from tidemark.sources import contracts
from tidemark.streaming import causal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    group = {}

    def top(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        group[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in similarity.label_components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {n: top(n) for n in group}


def test_components_of_a_long_chain(spark):
    path = [0, *range(130, 0, -1)]  # labels advance one hop a round here
    edges = [*zip(path[:-1], path[1:], strict=True), (900, 900)]
    got = {r.node: r.component for r in similarity.label_components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {n: 0 for n in path} | {900: 900}


def test_all_candidates_are_scored(spark):
    items = frame(spark, [(i, [1.0, float(i)]) for i in range(3)], "item long, embedding array<double>")
    roster = frame(spark, [(i, [1.0, i / 7]) for i in range(1200)], "candidate long, c_vec array<double>")
    for bound in (1000, 2000):
        rows = similarity.candidate_scores(items, roster, bound).select("item", "candidate").distinct()
        assert rows.count() == 3 * 1200


def test_clusters_and_selection(spark):
    def at(deg):
        return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]

    items = frame(spark, [("k", i, at(x), float(q)) for i, (x, q) in enumerate([(0, 5), (5, 9), (90, 1), (95, 2), (180, 3)])], "label string, item long, vec array<double>, quality double")
    clusters = {r.item: r.cluster for r in kernels.link_clusters(items, ["label"], 0.9).collect()}
    assert clusters == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert [r.item for r in kernels.non_redundant(items, ["label"], 3, 0.5).collect()] == [1, 4, 3]
    assert {r.item: r.into for r in kernels.absorb_similar(items, ["label"], 0.9).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {r.item: r.cluster for r in kernels.running_clusters(items, ["label"], 0.9).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    picks = [r.item for r in kernels.farthest_points(items, ["label"], 3).orderBy("pick").collect()]
    assert picks[0] == 2 and len(set(picks)) == 3 and 0 in picks and 4 in picks
    assert kernels.farthest_points(items, ["label"], 3, limit=2).orderBy("pick").collect() == kernels.farthest_points(items, ["label"], 3).orderBy("pick").collect()
    with pytest.raises(Exception, match="kernel takes"):
        kernels.non_redundant(items, ["label"], 3, 0.5, limit=2).collect()


def test_boxes_and_tracks(spark):
    boxes = frame(spark, [(0, 1, [0, 0, 10, 10], 0.9), (0, 2, [1, 1, 11, 11], 0.8), (0, 3, [50, 50, 60, 60], 0.1)], "frame long, item long, box array<int>, score double")
    assert sorted(r.item for r in kernels.suppress_boxes(boxes, ["frame"], 0.5).collect()) == [1, 3]
    moves = [(0, f, f * 10, [f * 4, 0, f * 4 + 10, 10], 0.9, "cat") for f in range(3)] + [(0, 1, 99, [90, 90, 99, 99], 0.9, "cat"), (0, 2, 98, [8, 0, 18, 10], 0.9, "dog")]
    tracks = {r.item: r.track for r in kernels.track_boxes(frame(spark, moves, "shot long, frame long, item long, box array<int>, score double, phrase string"), ["shot"], 0.3, 2).collect()}
    assert tracks[0] == tracks[10] == tracks[20] and len({tracks[99], tracks[98], tracks[0]}) == 3
    one = boxes.select(VEC.iou(F.col("box"), F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(5))).alias("x")).collect()
    assert [round(r.x, 3) for r in one] == [0.5, 0.316, 0.0]


def test_packed_spans(spark):
    spans = frame(spark, [("m", 0, 29), ("m", 30, 99), ("m", 100, 419), ("m", 420, 430)], "movie string, lo long, hi long")
    got = [(r.lo, r.hi) for r in kernels.pack_spans(spans, ["movie"], 60, 150).orderBy("chunk_id").collect()]
    assert got[0] == (0, 99) and got[-1][1] == 430
    assert all(b[0] == a[1] + 1 for a, b in zip(got, got[1:], strict=False)) and all(hi - lo + 1 <= 150 for lo, hi in got)


def test_as_of_strict_and_ties(spark):
    left = frame(spark, [("s", 5), ("s", 10), ("t", 1)], "story string, at long")
    right = frame(spark, [("s", 5, 1), ("s", 5, 2), ("s", 9, 3)], "story string, at long, rep long")
    got = lambda df: {(r.story, r.at): r.rep for r in df.collect()}
    assert got(joins.as_of(left, right, ["story"], "at", "rep")) == {("s", 5): 2, ("s", 10): 3, ("t", 1): None}
    assert got(joins.as_of(left, right, ["story"], "at", "rep", inclusive=False)) == {("s", 5): None, ("s", 10): 3, ("t", 1): None}
    assert got(joins.salted_as_of(left, right, ["story"], "at", "rep", 3)) == got(joins.as_of(left, right, ["story"], "at", "rep"))


def test_unknown_edit_raises(spark):
    items = frame(spark, [(1, "a")], "k long, v string")
    edits = frame(spark, [(2, "replace", "b")], "k long, action string, v string")
    with pytest.raises(Exception, match="unknown key 2"):
        joins.keyed_edits(items, edits, "k", "v").collect()


def test_point_in_chunk_clamps(spark):
    chunks = frame(spark, [("s", 0, 0, 10), ("s", 1, 20, 30), ("s", 2, 40, 50)], "story string, chunk_id long, lo long, hi long")
    events = frame(spark, [("s", x) for x in (-5, 0, 9, 15, 20, 49, 50)], "story string, sec long")
    got = {r.sec: r.chunk_id for r in timeline.event_chunks(events, chunks, "sec").collect()}
    assert got == {-5: 0, 0: 0, 9: 0, 15: 2, 20: 1, 49: 2, 50: 2}


def test_text_functions(spark):
    rows = frame(spark, [('"Old Mill" (Location)',), ("Tom -char",), ("lamp_prop",), ("灯塔",), ("  ",)], "name string")
    got = [(r.n, r.s) for r in rows.select(X.entity_name(F.col("name")).alias("n"), X.slug(F.col("name")).alias("s")).collect()]
    assert got[:3] == [("Old Mill", "old_mill"), ("Tom", "tom"), ("lamp", "lamp")]
    assert got[3][1].startswith("u_") and got[4][1] == "unnamed"


def test_sample_keeps_blocks_and_quota(spark):
    rows = frame(spark, [(i, "BLOCK" if i < 4 else "WARN" if i < 24 else "PASS") for i in range(204)], "seg long, verdict string")
    got = [r.verdict for r in rules.stratified_sample(rows, "seg", 0.05, 3, "x").collect()]
    assert got.count("BLOCK") == 4 and got.count("WARN") + got.count("PASS") == 10 and got.count("PASS") == 9
    assert rules.stratified_sample(rows.limit(0), "seg", 0.05, 3, "x").count() == 0


def test_sources(spark, tmp_path):
    gold = tmp_path / "registry.json"
    gold.write_text(json.dumps({"movie_id": "m", "entities": [{"entity_id": "e1", "kind": "prop", "reps": [{"representation_id": "r1", "chunk_id": 2}]}, {"entity_id": "e2"}]}, indent=1))
    rows = {r.entity_id: [x.representation_id for x in r.representations] for r in contracts.entities(contracts.read_documents(spark, str(gold), contracts.REGISTRY)).collect()}
    assert rows == {"e1": ["r1"], "e2": []}
    chunks = tmp_path / "chunks.json"
    chunks.write_text(json.dumps({"movie_id": "m", "chunks": [{"chunk_id": 0, "present": ["a", "b", "a"], "first_appearances": ["b"]}]}))
    assert contracts.gold_chunks(contracts.read_documents(spark, str(chunks), contracts.CHUNKS)).first().continuity == ["a", "a"]
    prompts = tmp_path / "prompts.json"
    prompts.write_text(json.dumps({"story_id": "s", "segments": [{"prompt": "x"}, {"prompt": "y", "duration_sec": 2.5}]}))
    got = contracts.prompt_segments(contracts.read_documents(spark, str(prompts), contracts.PROMPTS)).orderBy("idx").collect()
    assert [(r.segment_id, r.transition, r.duration_sec) for r in got] == [("seg_001", "cut", 5.0), ("seg_002", "cut", 2.5)]
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"uid": "u", "x": 1}\nnot json\n{"uid": "v", "x": 2}\n')
    assert contracts.read_lines(spark, str(lines), "uid string, x int", tolerant=True).where("uid is not null").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        contracts.read_lines(spark, str(lines), "uid string, x int").collect()
    for name, x in (("1.json", 1), ("2.json", 5)):
        (tmp_path / "j").mkdir(exist_ok=True)
        (tmp_path / "j" / name).write_text(json.dumps({"uid": "u", "x": x}))
    assert contracts.latest_judgments(spark, str(tmp_path / "j"), "uid string, x int", "uid").first().x == 5
    for parts in ("b1/d/s/name_anchored", "b1/d/s/name_anchored/B4", "b2/_visual_score/s/name_anchored"):
        folder = tmp_path / "runs" / parts
        folder.mkdir(parents=True)
        (folder / "score.json").write_text('{"f1": 0.5}')
    runs = {(r.baseline, r.dataset, r.sample, r["mode"], r.budget) for r in contracts.read_runs(spark, str(tmp_path / "runs"), "f1 double").collect()}
    assert runs == {("b1", "d", "s", "name_anchored", None), ("b1", "d", "s", "name_anchored", 4)}
    table = frame(spark, [("a", 1, "old"), ("b", 1, "only")], "k string, version long, v string")
    new = contracts.upsert(table, frame(spark, [("a", 2, "new")], table.schema), ["k"], "version")
    assert {r.k: r.v for r in new.collect()} == {"a": "new", "b": "only"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i) for s in range(4) for i in range(9)]
    frame(spark, rows, "story long, idx long").repartition(3).write.parquet(str(tmp_path / "turns.parquet"))
    got = {(r.story, r.idx): (r.sources, r.n_seen) for r in causal.drained(causal.answers(causal.read_stream(spark, str(tmp_path), "turns"), 2)).collect()}
    assert got == {(s, i): (",".join(str(j) for j in (i - 1, i - 2) if j >= 0), i) for s, i in rows}


def test_farthest_points_of_groups_of_any_size(spark):
    """Picks by rounds are those of one task a group."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("label % 3 as label", "vec_id as item", "embedding as vec")
    key = lambda df: sorted((r.label, r.pick, r.item) for r in df.collect())
    for novelty in (0.0, 0.95):
        small = kernels.farthest_points(e, ["label"], 4, novelty)
        assert key(small) == key(kernels.farthest_points(e, ["label"], 4, novelty, limit=0))


def test_farthest_points_of_a_null_key(spark):
    """A null key is a group like others in both ways, ties and all."""
    rows = [(k, i, [1.0, float(i % 3)]) for k in (None, 1) for i in range(9)]
    e = frame(spark, rows, "label long, item long, vec array<double>")
    key = lambda df: sorted(((r.label is None, r.pick, r.item) for r in df.collect()))
    small = key(kernels.farthest_points(e, ["label"], 3))
    assert len(small) == 6 and small == key(kernels.farthest_points(e, ["label"], 3, limit=0))


def test_coverage_fills_are_evenly_rounded(spark):
    """First, returns, and fills at round(i * (n - 1) / (need - 1)), halves to even; all if there is room."""
    cases = {"a": (list(range(12)), 5, [0, 1, 4, 8, 11]), "b": ([0, 5, 9, 10], 8, [0, 5, 9, 10]), "c": ([3, 4, 5], 2, [3, 4]), "d": ([0, 2, 4, 6], 2, [0, 2]), "e": (list(range(6)), 3, [0, 1, 5])}
    for eid, (idx, cap, want) in cases.items():
        rows = spark.createDataFrame([(1, i, eid, "prop") for i in idx], "story long, idx long, eid string, kind string")
        got = timeline.coverage_selection(rows, cap).orderBy("idx").collect()
        assert [r.idx for r in got] == want, eid

@pytest.mark.parametrize("part", [40, 1 << 20])
def test_components_join_parts_of_any_size(spark, part):
    rng = random.Random(part)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(60)] + [(300, k) for k in range(301, 340)]
    edges += [(None, 5), (7, None), (8, 8), *edges[:10]]
    of = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = of.setdefault(u, {u}), of.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    of[x] = a
    got = graph.components(frame(spark, edges, "u long, v long").repartition(7), part).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, min(s)) for x, s in of.items())
    assert graph.components(frame(spark, [], "u long, v long"), part).collect() == []


def test_small_and_large_groups_of_boxes_agree(spark):
    """groups of few boxes are folded by Spark, larger ones go to the kernel, with the same answer."""
    rng = random.Random(9)
    rows = [(f, f * 100 + i, [y := rng.randrange(60), x := rng.randrange(60), y + rng.randrange(50), x + 30], float(rng.randrange(9))) for f in range(12) for i in range(1 + f)]
    boxes = frame(spark, rows, "frame long, item long, box array<long>, score double")
    by_kernel = sorted(tuple(r) for r in kernels.suppress_boxes(boxes, ["frame"], 0.3, few=0).collect())
    for few in (5, 64):
        assert sorted(tuple(r) for r in kernels.suppress_boxes(boxes, ["frame"], 0.3, few=few).collect()) == by_kernel
    assert len(by_kernel) < len(rows)


def test_lost_tracks_are_not_walked_again(spark):
    """3,000 frames of tracks that end at once take as long as their boxes, not as frames times tracks."""
    rows = [(0, f, f * 10 + i, [0, f % 7 * 1000 + i * 200, 100, f % 7 * 1000 + i * 200 + 100], 0.5, "a") for f in range(3000) for i in range(5)]
    got = kernels.track_boxes(frame(spark, rows, "shot long, frame long, item long, box array<int>, score double, phrase string"), ["shot"], 0.3, 2)
    began = time.monotonic()
    assert got.select("track").distinct().count() == len(rows)
    assert time.monotonic() - began < 30
