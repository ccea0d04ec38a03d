"""Rule sets on small registries and annotations written out."""

import json
import time

from pyspark.sql import functions as F

from tidemark.operators import annotation, lint, postprocess
from tidemark.plans import lint_queries
from tidemark.sources import flatten

REP = "movie string, entity_id string, kind string, representation_id string, chunk_id long, bbox array<long>, bbox_source string, embedding_key string, crop_path string"
CHUNK = (
    "movie string, chunk_id long, present array<string>, first_appearances array<string>, prompt string, "
    "instructions array<struct<entity_id:string,requirement:string>>, forbidden array<struct<representation_id:string,reason:string>>"
)


def registry(spark, entities, present, prompt="Bunny appears.", box=(100, 100, 300, 300), events=()):
    ents = spark.createDataFrame([("m", i, k, n) for i, n, k in entities], "movie string, entity_id string, kind string, name string")
    reps = [("m", i, k, f"{i}@c000", 0, list(box), "grounding_dino" if k != "location" else "full_frame", f"{i}@c000", f"assets/{i}/c000.jpg") for i, _, k in entities]
    chunk = ("m", 0, present, present, prompt, [(e, "introduce") for e in present], [])
    events = spark.createDataFrame(list(events), "movie string, entity_id string, event_id string, chunk_id long, deprecates array<string>")
    movies = spark.createDataFrame([("m", None, False, None, [])], "movie string, roster_mode string, production_mode boolean, layout_chunks long, flagged array<int>")
    return ents, spark.createDataFrame(reps, REP), events, spark.createDataFrame([chunk], CHUNK), movies


def codes(df):
    return {(r.code, r.severity) for r in df.collect()}


def test_present_and_alias_pathologies(spark):
    parts = registry(
        spark, [("char_bunny", "Bunny", "character"), ("char_bunny_character", "Bunny (character)", "character")],
        ["char_bunny", "char_bunny", "missing"], "The scene continues in this location (chunk 0).",
    )
    found = {c for c, s in codes(lint.lint_registry(*parts, strict=True)) if s == "error"}
    assert {"duplicate_present", "unknown_present_entity", "suffix_alias_entity", "canonical_alias_split", "placeholder_prompt"} <= found
    assert ("placeholder_prompt", "warning") in codes(lint.lint_registry(*parts))
    assert [tuple(r) for r in lint.publishable(lint.lint_registry(*parts), parts[4]).select("movie", "ok").collect()] == [("m", False)]


def test_one_box_for_two_entities(spark):
    parts = registry(spark, [("char_squirrel", "Squirrel", "character"), ("prop_acorn", "Acorn", "prop")], ["char_squirrel", "prop_acorn"], box=(100, 100, 500, 500))
    assert ("same_chunk_bbox_conflict", "error") in codes(lint.lint_registry(*parts))


def test_clean_registry_and_late_events(spark):
    late = [("m", "char_a", "ev", 0, ["char_a@c000"])]
    parts = registry(spark, [("char_a", "A", "character")], ["char_a"], events=late)
    assert codes(lint.lint_registry(*parts)) == set()  # an event forbids in later chunks only
    report = lint.lint_report(lint.lint_registry(*parts), "Gold").orderBy("part", "key").collect()
    assert [r.line for r in report] == ["# Gold", "## Findings"]


def note(**changes):
    doc = {
        "video_duration_seconds": 10.0, "characters": [], "props": [], "locations": [{"loc_id": "loc_001", "name": "Hall"}],
        "screenplay": {"scenes": [{"scene_id": "scene_0001", "loc_id": "loc_001", "visual_segments": [
            {"segment_id": "seg_0001", "start_seconds": 0.0, "end_seconds": 10.0, "duration_seconds": 10.0, "present_entity_ids": ["loc_001"]}]}]},
        "self_check": {"low_confidence_segment_ids": []}, "counts": {"characters": 0, "props": 0, "locations": 1, "scenes": 1, "visual_segments": 1},
    }
    return doc | changes


def docs(spark, *notes):
    return postprocess.parsed(spark.createDataFrame([(i, n if isinstance(n, str) else json.dumps(n)) for i, n in enumerate(notes)], "movie long, text string"))


def test_valid_annotation_has_no_findings(spark):
    a = docs(spark, note())
    for rules in (postprocess.structure_findings, postprocess.entity_findings, postprocess.segment_findings):
        assert rules(a).collect() == []
    assert [tuple(r) for r in postprocess.segment_index(a).collect()] == [(0, "seg_0001", "scene_0001", 0.0, 10.0)]


def test_wrong_types_are_findings(spark):
    people = [1, {"name": "x"}, {"char_id": "c", "name": " ", "first_presence_seconds": "soon"}, {"char_id": "c", "name": "C", "first_presence_seconds": 9, "last_presence_seconds": 3, "state_changes": "none"},
              {"char_id": "d", "name": "D", "state_changes": [4, {"seconds": "x"}, {"seconds": 11}]}]
    scenes = ["no", {"visual_segments": 3}, {"visual_segments": [7, {"segment_id": "s", "start_seconds": 3, "end_seconds": 1, "present_entity_ids": ["c", "c", "", "zz"]}, {"segment_id": "s", "present_entity_ids": "c"}]}]
    a = docs(spark, note(characters=people, props="none", screenplay={"scenes": scenes}, self_check={"low_confidence_segment_ids": ["s", "t"]}, counts={"props": 4}), "{broken", "[1]")
    assert codes(postprocess.entity_findings(a)) == {
        ("INVALID_ENTITY", "error"), ("MISSING_ENTITY_ID", "error"), ("DUPLICATE_ENTITY_ID", "error"), ("EMPTY_ENTITY_NAME", "error"), ("INVALID_PRESENCE_TIME", "warning"),
        ("PRESENCE_TIME_OUT_OF_RANGE", "warning"), ("INVALID_STATE_CHANGES", "warning"), ("INVALID_STATE_EVENT", "warning"), ("INVALID_STATE_EVENT_TIME", "warning"),
    }
    assert {c for c, _ in codes(postprocess.segment_findings(a))} == {
        "INVALID_SCENE", "INVALID_SEGMENTS", "INVALID_SEGMENT", "INVALID_SEGMENT_TIME", "DUPLICATE_SEGMENT_ID", "INVALID_PRESENT", "DUPLICATE_PRESENT_ENTITY_ID", "UNKNOWN_PRESENT_ENTITY_ID",
        "UNKNOWN_SELF_CHECK_SEGMENT",
    }
    found = sorted((r.movie, r.code) for r in postprocess.structure_findings(a).collect())
    assert found == [(0, "COUNT_MISMATCH"), (0, "INVALID_COLLECTION"), (1, "INVALID_ROOT"), (2, "INVALID_ROOT")]


def test_normal_form(spark):
    people = [{"char_id": "b"}, {"name": "no id"}, {"char_id": "a"}]
    scenes = [{"scene_id": "late", "start_seconds": 5, "visual_segments": [{"start_seconds": 8}, {"start_seconds": 6}]}, {"scene_id": "early", "start_seconds": 1}, {"scene_id": "never"}]
    (row,) = postprocess.normalized(docs(spark, note(characters=people, screenplay={"scenes": scenes}, counts={}))).collect()
    assert [json.loads(v.toJson()) for v in row.characters] == [{"char_id": "a"}, {"char_id": "b"}, {"name": "no id"}]
    assert [s.scene_id for s in row.scenes] == ["early", "late", "never"]
    assert [json.loads(v.toJson())["start_seconds"] for v in row.scenes[1].visual_segments] == [6, 8]
    assert row.counts.asDict() == {"characters": 3, "props": 0, "locations": 1, "scenes": 3, "visual_segments": 2}


def test_flat_actions(spark):
    source = {"scenes": [
        {"id": 1, "present": ["a"], "actions": ["Go. ", {"action": "Stay", "present": ["b"], "events": [{"x": 2}]}, {"action": "End"}], "events": [{"at": 1, "x": 1}]},
        {"id": "z", "actions": ["Cut"]}, {"id": "empty", "actions": []}, {"id": "off", "actions": ["x"], "events": [{"at": 3}]},
    ]}
    df = docs(spark, source).withColumnRenamed("movie", "story")
    rows = flatten.flat_actions(df).orderBy("idx").collect()
    assert [(r.idx, r.action, r.present, r.transition, [json.loads(e.toJson()) for e in r.events]) for r in rows] == [
        (0, "Go.", ["a"], "cut", []), (1, "Stay", ["b"], "continue", [{"at": 1, "x": 1}, {"x": 2}]), (2, "End", ["a"], "continue", []), (3, "Cut", [], "cut", []), (4, "x", [], "cut", []),
    ]
    assert [(r.scene_id, r.fault) for r in flatten.source_faults(df).collect()] == [("empty", "no_actions"), ("off", "event_out_of_range")]


def test_conflicts_between_entities(spark):
    def gate(*scores):
        rows = [(i, 10, 2453, "character", f"/tmp/{i}.png", [100, 100, 400, 400], s) for i, s in enumerate(scores)]
        df = spark.createDataFrame(rows, "item long, chunk_id long, frame long, kind string, path string, box array<long>, score double")
        return [r.kept for r in annotation.conflict_winners(df, 0.95, 0.15).orderBy("item").collect()]

    assert gate(0.5, 0.5) == [False, False] and gate(0.9, 0.2) == [True, False] and gate(0.3) == [True]


def test_chunks_that_are_not_there(spark):
    """A layout without chunks, and chunks without a forbidden table, are findings too."""
    ents = spark.createDataFrame([(m, "prop_kite", "prop", "Kite") for m in (4, 5, 6)], "movie long, entity_id string, kind string, name string")
    reps = spark.createDataFrame([], "movie long, entity_id string, kind string, representation_id string, chunk_id long, bbox array<long>, bbox_source string, embedding_key string, crop_path string")
    events = spark.createDataFrame([(6, "prop_kite", "ev_torn", 0, ["prop_kite@c000"]), (6, "prop_kite", "ev_late", 2, ["prop_kite@c001"])], "movie long, entity_id string, event_id string, chunk_id long, deprecates array<string>")
    forbidden = "forbidden array<struct<representation_id:string,reason:string>>"
    rows = [(m, c, ["prop_kite"], [], "Walk on.", [("prop_kite", "continuity")], f) for m, c, f in [
        (5, 0, None), (6, 0, None), (6, 1, None), (6, 2, [("prop_kite@c000", "ev_torn"), ("prop_kite@c000", "ev_torn")]), (6, 3, [("prop_kite@c000", "ev_torn")])]]
    chunks = spark.createDataFrame(rows, f"movie long, chunk_id long, present array<string>, first_appearances array<string>, prompt string, instructions array<struct<entity_id:string,requirement:string>>, {forbidden}")
    movies = spark.createDataFrame([(4, "seeded", True, 5, []), (5, "seeded", True, 1, []), (6, "seeded", True, None, [])], "movie long, roster_mode string, production_mode boolean, layout_chunks long, flagged array<int>")
    got = {(r.movie, r.code, r.path) for r in lint.chunk_rules(ents, reps, events, chunks, movies).collect()}
    assert got == {(4, "layout_chunk_count_mismatch", ""), (6, "forbidden_mismatch", "chunks[1]"), (6, "forbidden_mismatch", "chunks[3]")}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_read_in_one_pass(spark):
    """a nested field names its document a few times, not a power of its depth, and ids meet in a window, not in joins of the documents with themselves."""
    deep = postprocess.items(postprocess.field(postprocess.field(F.col("doc"), "screenplay"), "scenes"))
    assert str(deep).count("doc") <= 2
    plan = plan_of(postprocess.segment_findings(docs(spark, note())))
    assert "Join" not in plan and "Union" not in plan


def test_ids_of_segments_and_entities_do_not_mix(spark):
    shown = [{"segment_id": "x", "start_seconds": 0, "end_seconds": 1, "present_entity_ids": e} for e in (["s"], ["x", "e", "e"])]
    a = docs(spark, note(characters=[{"char_id": "e", "name": "E"}], screenplay={"scenes": [{"visual_segments": shown[:1]}, {"visual_segments": shown[1:]}]}, self_check={"low_confidence_segment_ids": ["x", "e", "e"]}))
    path = "$.screenplay.scenes[%d].visual_segments[0]"
    assert sorted((r.code, r.path) for r in postprocess.segment_findings(a).collect()) == sorted([
        ("DUPLICATE_SEGMENT_ID", path % 1 + ".segment_id"), ("DUPLICATE_PRESENT_ENTITY_ID", path % 1 + ".present_entity_ids"), ("UNKNOWN_PRESENT_ENTITY_ID", path % 0 + ".present_entity_ids"),
        ("UNKNOWN_PRESENT_ENTITY_ID", path % 1 + ".present_entity_ids"), *[("UNKNOWN_SELF_CHECK_SEGMENT", "$.self_check.low_confidence_segment_ids")] * 2,
    ])


def test_structure_tells_kinds_without_schemas(spark):
    """the schema of a whole document is not written out for each of its rules."""
    assert plan_of(postprocess.structure_findings(docs(spark, note()))).count("schemaOfVariant(doc") == 0


def test_entities_are_read_in_one_pass(spark):
    """an entity and its state changes are judged together."""
    plan = plan_of(postprocess.entity_findings(docs(spark, note())))
    assert "Union" not in plan and plan.count("Window [") == 1


def test_flat_segments_bring_their_place_along(spark):
    """a segment's place comes from its own scene, not from a join of the documents with themselves."""
    scenes = [{"loc_id": " hall ", "visual_segments": [{"start_seconds": 4, "end_seconds": 2}]}, {"visual_segments": [{"start_seconds": 1}]}]
    rows = flatten.flat_segments(docs(spark, note(screenplay={"scenes": scenes})))
    assert "Join" not in plan_of(rows)
    assert sorted((r.idx, r.start, r.end_, r.loc_id) for r in rows.collect()) == [(0, 1.0, 1.0, ""), (1, 2.0, 4.0, "hall")]


def test_normal_form_reads_a_field_once(spark):
    """the segments of the normal form are two fields deep; each step names what it is taken from once or twice."""
    seg = postprocess.number(postprocess.field(postprocess.field(F.col("v"), "visual"), "start_seconds"))
    assert str(seg).count("variant_get(v") <= 2


def test_presences_do_not_carry_their_chunk(spark):
    """20,000 presences of one chunk, of which the last instruction counts; a chunk that is there twice is judged twice."""
    ids = [f"e{i}" for i in range(20_000)]
    told = [(i, "introduce" if n % 2 else "continuity") for n, i in enumerate(ids) if n != 7]
    big = ("m", 1, [*ids, None], [i for n, i in enumerate(ids) if n % 2 and n != 9], "", told, [])
    twice = ("m", 0, ["a", "a", "b", "c"], ["b"], "", [("a", "introduce"), ("a", "continuity"), ("b", "continuity")], [])
    began = time.monotonic()
    got = lint.wrong_instructions(spark.createDataFrame([big, twice, twice], CHUNK)).groupBy("chunk_id").count().collect()
    assert {r.chunk_id: r["count"] for r in got} == {0: 4, 1: 3}
    assert time.monotonic() - began < 60


def test_boxes_of_one_place_are_compared_once(spark):
    """every two representations of near boxes clash, also where boxes are equal, but not those of one entity or of other chunks."""
    at = {"e1": [(0, 0, 100, 100), (0, 0, 100, 99)], "e2": [(0, 0, 100, 100), (500, 0, 600, 100)], "e3": [(0, 0, 100, 99)]}
    reps = [("m", e, "prop", f"{e}@{n}", c, list(b), "grounding_dino", "", "") for c in (0, 1) for e, boxes in at.items() for n, b in enumerate(boxes)]
    chunks = spark.createDataFrame([("m", 0, [], [], "", [], [])] * 2, CHUNK)
    got = lint.box_clashes(spark.createDataFrame(reps, REP), chunks, 0.95).collect()
    assert [tuple(r) for r in got] == [("m", 0)] * 5


def test_chunks_are_made_once(spark):
    """the rules of a chunk read one copy of the chunks, however they were made."""
    chunks = spark.createDataFrame([("m", 0, ["a"], [], "", [("a", "continuity")], [])], CHUNK).withColumn("prompt", F.concat("prompt", F.lit("made here")))
    ents = spark.createDataFrame([("m", "a", "prop", "A")], "movie string, entity_id string, kind string, name string")
    events = spark.createDataFrame([], "movie string, entity_id string, event_id string, chunk_id long, deprecates array<string>")
    movies = spark.createDataFrame([("m", None, False, None, [])], "movie string, roster_mode string, production_mode boolean, layout_chunks long, flagged array<int>")
    rules = lint.chunk_rules(ents, spark.createDataFrame([], REP), events, chunks, movies)
    assert rules.collect() == [] and "made here" not in plan_of(rules)


def test_crops_meet_entities_without_a_broadcast(spark):
    """the entities of a large registry do not fit a broadcast."""
    reps = lint_queries.registry(spark, "/root/testdata/sf0.001")[1]
    assert "strategy=merge" in plan_of(reps)
