"""Selections, unfinished annotations and tables of segments by files written out."""

import json

from pyspark.sql import functions as F

from tidemark.sources import selections as S


def put(path, document):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document, indent=1))


def chunk(n, *items, **more):
    return {"chunk_id": n, "selected": [{"asset_id": f"e{i}", "representations": reps} for i, reps in enumerate(items)], **more}


def test_images_of_selections(spark, tmp_path):
    chunks = [
        chunk(0, [{"crop_abspath": "/x/a.png", "crop_path": "a.png"}, {"crop_abspath": "", "crop_path": "b.png"}], [{"crop_path": "c.png", "source_seconds": 4}], retrieval_timing={"retrieval_ms": 1.5}),
        chunk(1, [{"source_seconds": 2.5}, {"crop_path": "", "source_seconds": 9}, {"name": "nothing"}], None),
        {"chunk_id": 2, "selected": None}, chunk(3, [{"crop_path": "old.png"}]), chunk(3, [{"crop_path": "new.png"}]),
    ]
    put(tmp_path / "new" / "bm25.json", {"movie": "m", "system": "bm25", "chunks": chunks})
    put(tmp_path / "old" / "bm25.json", {"movie": "m", "system": "bm25", "chunks": [chunk(8, [{"crop_path": "z"}])]})
    put(tmp_path / "old" / "dense.json", {"movie": "m", "system": "dense", "chunks": [chunk(9, [{"crop_path": "y"}])]})
    rows = S.selected_images(S.read_selections(spark, str(tmp_path / "new"), str(tmp_path / "old"))).collect()
    assert {(r.system, r.chunk_id): [tuple(i) for i in r.images] for r in rows} == {
        ("bm25", 0): [("/x/a.png", None), ("b.png", None), ("c.png", None)], ("bm25", 1): [(None, 2.5)], ("bm25", 2): [],
        ("bm25", 3): [("new.png", None)], ("dense", 9): [("y", None)],
    }
    assert {r.chunk_id: r.timing for r in rows if r.system == "bm25"} == {0: {"retrieval_ms": 1.5}, 1: {}, 2: {}, 3: {}}


def test_documents_of_rows(spark):
    schema = "movie string, system string, chunk_id int, prompt string, item int, asset_id string, place int, name string, kind string, crop_path string, crop_abspath string, source_seconds double"
    rows = [
        ("m", "s", 1, "go", 1, "e2", 0, "Bo", "character", "b.png", None, None), ("m", "s", 1, "go", 0, "e1", 1, "Al", "character", None, None, 3.0),
        ("m", "s", 1, "go", 0, "e1", 0, "Al", "character", "a.png", "/x/a.png", None), ("m", "s", 0, None, None, None, None, None, None, None, None, None), ("m", "t", 4, "x", 0, None, 0, None, None, "q", None, None),
    ]
    got = {r.system: json.loads(r.document) for r in S.selection_documents(spark.createDataFrame(rows, schema)).collect()}
    assert got["s"] == {"movie": "m", "system": "s", "chunks": [
        {"chunk_id": 0, "prompt": "", "selected": []},
        {"chunk_id": 1, "prompt": "go", "selected": [
            {"asset_id": "e1", "representations": [{"name": "Al", "kind": "character", "crop_path": "a.png", "crop_abspath": "/x/a.png"}, {"name": "Al", "kind": "character", "source_seconds": 3.0}]},
            {"asset_id": "e2", "representations": [{"name": "Bo", "kind": "character", "crop_path": "b.png"}]},
        ]},
    ]}
    assert got["t"]["chunks"][0]["selected"][0]["representations"] == [{"crop_path": "q"}]


def test_unfinished_annotations(spark, tmp_path):
    put(tmp_path / "a" / "tmp" / "checkpoint.json", {"chunks": [{"chunk_id": 2, "present": ["e"]}], "human_reviewed": True})
    put(tmp_path / "a" / "tmp" / "checkpoint_registry.json", {"movie_id": "ma", "schema_version": "2", "entities": []})
    put(tmp_path / "b" / "tmp" / "checkpoint.json", {"movie_id": "own"})
    put(tmp_path / "b" / "tmp" / "checkpoint_registry.json", {"movie_id": "mb"})
    put(tmp_path / "c" / "tmp" / "checkpoint.json", {"movie_id": "alone", "chunks": []})
    got = sorted((r.movie_id, r.schema_version, r.human_reviewed, [c.chunk_id for c in r.chunks]) for r in S.read_checkpoints(spark, str(tmp_path)).collect())
    assert got == [("ma", "2", False, [2]), ("own", None, False, [])]


def test_table_of_segments(spark, tmp_path):
    scores = spark.createDataFrame([("m", "s", i, i * 2.0, None if i == 2 else 0.5) for i in (3, 1, 2)] + [("n", "t", 0, 0.0, 1.0)], "movie string, system string, segment_id int, sec_start double, f1 double")
    S.write_segments(scores, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["movie", *S.SEGMENT, "system"]
    assert sorted((r.system, r.movie, r.segment_id, r.sec_start, r.f1, r.recall) for r in back.collect()) == [("s", "m", "1", "2.0", "0.5", None), ("s", "m", "2", "4.0", None, None), ("s", "m", "3", "6.0", "0.5", None), ("t", "n", "0", "0.0", "1.0", None)]
    assert back.where(F.col("system") == "t").count() == 1
