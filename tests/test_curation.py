"""Gates and choices on small inputs written out."""

from tidemark.operators import curation, kernels


def test_perception_gate_takes_pairs_in_order(spark):
    box = [0, 0, 500, 500]
    rows = [(1, i, "prop", "grounding_dino", box) for i in (1, 2, 3)] + [(1, 4, "location", "grounding_dino", box), (1, 5, "prop", "grounding_dino", [0, 0, 1000, 990]), (2, 1, "prop", "full_frame", box)]
    df = spark.createDataFrame(rows, "chunk long, seq long, kind string, bbox_source string, bbox array<long>")
    got = {(r.chunk, r.seq): r.blocked for r in curation.perception_gate(df, 0.95, 0.95).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (1, 4): False, (1, 5): True, (2, 1): False}  # the third meets only blocked ones


def test_strict_answers(spark):
    texts = ['{"entity_ids": ["b", "a", "b"]}', '{"entity_ids": ["z"]}', '{"entity_ids": []}', '{"entity_ids": [null]}', '{"other": 1}', "no", None]
    df = spark.createDataFrame([(i, t, ["a", "b"]) for i, t in enumerate(texts)], "i int, text string, allowed array<string>")
    got = df.select("i", curation.strict_answer(df["text"], df["allowed"]).alias("ids")).orderBy("i").collect()
    assert [r.ids for r in got] == [["a", "b"], None, [], None, None, None, None]


def test_packing_splits_oversize_and_joins_short(spark):
    spans = [("m", 0, 399), ("m", 400, 419), ("m", 420, 459), ("m", 460, 509), ("m", 600, 610)]
    df = spark.createDataFrame(spans, "movie string, lo long, hi long")
    got = [(r.lo, r.hi) for r in kernels.pack_spans(df, ["movie"], 60, 150).orderBy("chunk_id").collect()]
    assert got == [(0, 133), (134, 267), (268, 399), (400, 509), (600, 610)]


def test_exclusive_assignment(spark):
    rows = [("s", 1, "a", 0.9), ("s", 1, "b", 0.5), ("s", 2, "a", 0.95), ("s", 2, "b", 0.2), ("s", 3, "a", 0.6), ("s", 3, "b", 0.58), ("s", 4, "b", 0.1), ("s", 5, "b", 0.4)]
    df = spark.createDataFrame(rows, "shot string, candidate long, entity string, sim double")
    got = {(r.entity, r.candidate) for r in curation.exclusive_assignment(df, ["shot"], 0.28, 0.06).collect()}
    assert got == {("a", 2), ("b", 5)}
