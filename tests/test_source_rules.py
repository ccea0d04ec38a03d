"""Each rule of author sources by a case that breaks it."""

from tidemark.operators import source_rules

PRESENT, EVENTS, REGISTRY = "story long, idx long, eid string, state string", "story long, idx long, place long, type string, eid string, to string, shown boolean", "story long, eid string, states array<string>"
NAMES = [(1, "lamp", ["lit", "dark"]), (1, "cat", None), (2, "lamp", None)]


def faults(spark, present, events):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((present, PRESENT), (events, EVENTS), (NAMES, REGISTRY))]
    return sorted((tuple(r) for r in source_rules.source_faults(*frames).collect()), key=str)


def test_a_sound_source(spark):
    present = [(1, 0, "lamp", None), (1, 1, "lamp", None), (1, 2, "lamp", "lit"), (1, 3, "cat", None), (2, 9, "lamp", "any")]
    events = [(1, 1, 0, "state_change", "lamp", "burnt", None), (1, 1, 1, "state_change", "lamp", "dark", None), (1, 3, 0, "remove", "cat", None, None), (1, 4, 0, "remove", "lamp", "gone", False), (2, 9, 0, "state_change", "lamp", "blue", None)]
    assert faults(spark, present, events) == []


def test_removal(spark):
    present = [(1, 0, "cat", None), (1, 1, "cat", None), (1, 5, "cat", None), (1, 5, "cat", None), (2, 5, "lamp", None)]
    events = [(1, 1, 0, "remove", "cat", None, True), (1, 4, 0, "remove", "cat", None, False), (1, 2, 0, "remove", "lamp", None, None), (1, 2, 1, "remove", "owl", None, None), (2, 5, 0, "remove", "lamp", None, True), (2, 5, 1, "remove", "lamp", None, False)]
    assert faults(spark, present, events) == [(1, 2, "lamp", "removed_unseen", None), (1, 2, "owl", "unknown_removed", None), (1, 5, "cat", "removed_reenters", "1"), (1, 5, "cat", "removed_reenters", "1")]


def test_states_and_names(spark):
    present = [(1, 0, "lamp", "lost"), (1, 1, "lamp", None), (1, 2, "lamp", "lit"), (1, 3, "lamp", None), (1, 4, "lamp", None), (1, 4, "owl", None), (3, 0, "cat", None), (None, 0, "cat", None)]
    events = [(1, 1, 0, "state_change", "lamp", "blue", None), (1, 2, 0, "state_change", "lamp", "blue", None), (1, 3, 0, "state_change", "lamp", None, None), (1, 3, 1, "melt", "lamp", None, None), (1, 3, 2, None, "lamp", None, None), (1, 4, 0, "remove", "lamp", "ash", True)]
    found = faults(spark, [p for p in present if p[0]], events)
    assert [f for f in found if f[3] != "unknown_event"] == [(1, 0, "lamp", "unknown_past_state", "lost"), (1, 1, "lamp", "unknown_state", "blue"), (1, 4, "lamp", "unknown_state", "ash"), (1, 4, "owl", "unknown_present", None), (3, 0, "cat", "unknown_present", None)]
    assert {f[4] for f in found if f[3] == "unknown_event"} == {"melt", None}
    nobody = spark.createDataFrame([p for p in present if p[0] is None], PRESENT)
    empty = spark.createDataFrame([], EVENTS), spark.createDataFrame([], REGISTRY)
    assert [r.code for r in source_rules.source_faults(nobody, *empty).collect()] == ["unknown_present"]


def test_persist_needs_a_transform(spark):
    cast = [(1, 0, "a", "introduce"), (1, 1, "a", "persist"), (1, 2, "a", "transform"), (1, 3, "a", "persist"), (2, 4, "a", "persist")]
    got = source_rules.persist_faults(spark.createDataFrame(cast, "story long, idx long, eid string, op string"))
    assert sorted((r.story, r.idx) for r in got.collect()) == [(1, 1), (2, 4)]
