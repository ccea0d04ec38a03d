"""Registry patches: chains, lines that don't apply, and their cascade."""

from tidemark.operators import patches


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def world(spark):
    """Ferry is folded into boat and boat into ship; a gull is dropped; the second story has no patch."""
    entities = frame(spark, [
        ("m", "ship", "prop", "Ship", None, 4), ("m", "boat", "prop", "Boat", "old", 2), ("m", "ferry", "prop", "Ferry", None, 0), ("m", "gull", "character", "Gull", None, 1),
        ("m", "pier", "location", "Pier", "", 0), ("n", "ferry", "prop", "Ferry", None, 3), (None, "boat", "prop", "Boat", None, 7),
    ], "story string, eid string, kind string, name string, description string, first_chunk long")
    patch = frame(spark, [
        ("m", 0, "merge", "ferry", "boat"), ("m", 1, "merge", "boat", "ship"), ("m", 2, "merge", "pier", "boat"), ("m", 3, "merge", "pier", "pier"), ("m", 4, "merge", "ferry", "pier"), ("m", 5, "merge", "ghost", "pier"),
        ("m", 6, "drop", "gull", None), ("m", 7, "drop", "ghost", None), ("m", 8, "rename", "ship", "Liner"), ("m", 9, "rename", "boat", "Dinghy"), ("m", 10, "describe", "pier", "wet"), ("m", 11, "prompt", "3", "fog"), ("m", 12, "prompt", "x", "?"),
    ], "story string, place long, op string, eid string, value string")
    return entities, patch, patches.id_map(patch, entities)


def test_chains_end_at_the_last_survivor(spark):
    entities, patch, ids = world(spark)
    assert rows(ids, "story", "eid", "new_id") == [("m", "boat", "ship"), ("m", "ferry", "ship"), ("m", "gull", None)]
    after = {(r.story, r.eid): (r.name, r.description, r.first_chunk) for r in patches.patched_entities(entities.where("story is not null"), ids, patch).collect()}
    assert after == {("m", "ship"): ("Liner", None, 0), ("m", "pier"): ("Pier", "wet", 0), ("n", "ferry"): ("Ferry", None, 3)}


def test_a_dropped_target_takes_what_was_merged_into_it(spark):
    entities = frame(spark, [(1, "a", 0), (1, "b", 0), (1, "c", 0)], "story long, eid string, first_chunk long")
    lines = [(1, 0, "drop", "b", None), (1, 1, "merge", "a", "b"), (1, 2, "merge", "c", "a")]
    ids = patches.id_map(frame(spark, lines, "story long, place long, op string, eid string, value string"), entities)
    assert sorted((r.eid, r.new_id) for r in ids.collect()) == [("a", None), ("b", None)]  # c came too late: a was gone
    none = patches.id_map(frame(spark, [(1, 0, "merge", "a", "a")], "story long, place long, op string, eid string, value string"), entities)
    assert none.collect() == []


def test_long_chain(spark):
    n = 400
    entities = frame(spark, [(1, f"e{k}", k) for k in range(n + 1)], "story long, eid string, first_chunk long")
    lines = frame(spark, [(1, k, "merge", f"e{k}", f"e{k + 1}") for k in range(n)], "story long, place long, op string, eid string, value string")
    ids = patches.id_map(lines, entities)
    assert {r.new_id for r in ids.collect()} == {f"e{n}"} and ids.count() == n


def test_representations_are_rekeyed(spark):
    ids = world(spark)[2]
    reps = frame(spark, [("m", "ferry", "ferry@3", "ferry@3"), ("m", "ferry", "ferry2@3", "k"), ("m", "ship", "ship@1", "ship@1"), ("m", "gull", "gull@1", "gull@1"), ("n", "ferry", "ferry@9", "ferry@9"), ("m", "boat", None, None)], "story string, eid string, representation_id string, embedding_key string")
    got = {tuple(r) for r in patches.patched_representations(reps, ids).select("story", "eid", "representation_id", "embedding_key").collect()}
    assert got == {("m", "ship", "ship@3", "ship@3"), ("m", "ship", "ferry2@3", "k"), ("m", "ship", "ship@1", "ship@1"), ("n", "ferry", "ferry@9", "ferry@9"), ("m", "ship", None, None)}


def test_chunks_follow(spark):
    entities, patch, ids = world(spark)
    after = patches.patched_entities(entities, ids, patch)
    chunks = frame(spark, [("m", 0, ["ferry", "pier"], "a"), ("m", 1, ["gull"], "b"), ("m", 3, ["boat", "ship", "pier", "who"], "c"), ("m", 4, [], "d"), ("m", 5, None, "e"), ("n", 3, ["ferry"], "f")], "story string, chunk_id long, present array<string>, prompt string")
    got = {(r.story, r.chunk_id): (r.present, r.first_appearances, [i.requirement for i in r.instructions], r.tags, r.prompt) for r in patches.patched_chunks(chunks, after, ids, patch).collect()}
    assert got == {
        ("m", 0): (["pier", "ship"], ["pier", "ship"], ["introduce"] * 2, "none", "a"),
        ("m", 1): ([], [], [], "none", "b"),
        ("m", 3): (["pier", "ship", "who"], [], ["continuity"] * 3, "return_location,return_prop", "fog"),
        ("m", 4): ([], [], [], "none", "d"),
        ("m", 5): ([], [], [], "none", "e"),
        ("n", 3): (["ferry"], ["ferry"], ["introduce"], "none", "f"),
    }


def test_dispositions_must_match(spark):
    patch = world(spark)[1]
    schema = "story string, eid string, action string"
    assert patches.disposition_faults(patch, frame(spark, [], schema)).count() == 0
    records = [("m", e, "merged") for e in ("ferry", "boat", "pier", "gull")] + [("m", "ghost", "dropped")]
    assert rows(patches.disposition_faults(patch, frame(spark, records, schema)), "eid", "needs") == [("ghost", "merged"), ("gull", "dropped")]
