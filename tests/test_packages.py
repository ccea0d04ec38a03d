"""Publishing: faults by written-out files, versions that appear whole or not at all, hashes."""

import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import packages

FILES = "movie string, file string, schema_version string, layout_hash string, human_reviewed boolean"


def shipped(movie, **changes):
    rows = {
        "manifest.json": (None, None, None), "gold/shot_boundaries.csv": (None, None, None), "gold/chunk_index.json": ("2", "ab", None),
        "gold/entity_registry.json": ("2", None, True), "gold/chunk_annotations.json": ("2", None, True), "notes.txt": ("9", None, False),
    }
    short = {"index": "gold/chunk_index.json", "registry": "gold/entity_registry.json", "chunks": "gold/chunk_annotations.json", "manifest": "manifest.json"}
    rows |= {short[k]: v for k, v in changes.items()}
    return [(movie, f, *v) for f, v in rows.items() if v is not None]


def judged(spark, files, findings=(), force=False, movies=None):
    names = movies or sorted({f[0] for f in files})
    m = spark.createDataFrame([(n,) for n in names], "movie string")
    faults = packages.package_faults(m, spark.createDataFrame(files, FILES), spark.createDataFrame(list(findings), "movie string, code string, severity string"))
    return sorted(tuple(r) for r in faults.collect()), {r.movie: r.outcome for r in packages.package_verdicts(m, faults, force).collect()}


def test_faults(spark):
    files = [
        *shipped("sound"), *shipped("sound"), *shipped("unseen", registry=("2", None, False), chunks=("2", None, None)), *shipped("mixed", chunks=("3", None, True)),
        *shipped("blank", index=("", None, None)), *shipped("gone", manifest=None, registry=None), *shipped("linted"), *shipped("stranger"),
    ]
    findings = [("linted", "unknown_present", "error"), ("linted", "unknown_present", "error"), ("sound", "odd", "warning"), ("stranger", "x", "error")]
    names = ["sound", "unseen", "mixed", "blank", "gone", "linted", "nothing"]
    faults, outcome = judged(spark, files, findings, movies=names)
    assert [f for f in faults if f[0] != "nothing"] == [
        ("blank", "missing_layout_hash", "gold/chunk_index.json", "quality"), ("blank", "missing_schema_version", "gold/chunk_index.json", "quality"),
        ("gone", "missing_file", "gold/entity_registry.json", "missing"), ("gone", "missing_file", "manifest.json", "missing"), ("linted", "lint:unknown_present", "2", "quality"),
        ("mixed", "schema_version_mismatch", "2 / 3", "quality"), ("unseen", "not_reviewed", "gold/chunk_annotations.json", "unfrozen"), ("unseen", "not_reviewed", "gold/entity_registry.json", "unfrozen"),
    ]
    assert sum(f[0] == "nothing" for f in faults) == 5
    assert outcome == {"sound": "published", "unseen": "unfrozen", "mixed": "quality", "blank": "quality", "gone": "missing", "linted": "quality", "nothing": "missing"}
    assert judged(spark, files, findings, True, names)[1]["unseen"] == "published"


def test_versions_and_reads(spark, tmp_path):
    target = str(tmp_path / "gold")
    with pytest.raises(packages.NotPublished, match="no version"):
        packages.read_package(spark, target)
    one, none = spark.range(5).withColumn("v", F.lit(None).cast("string")), spark.createDataFrame([], "a int")
    assert packages.publish(spark, {"rows": one, "none": none}, target) == 1
    assert packages.publish(spark, {"rows": spark.range(7)}, target + "/") == 2
    assert {n: t.count() for n, t in packages.read_package(spark, target).items()} == {"rows": 7}
    first = packages.read_package(spark, target, 1)
    assert {n: t.count() for n, t in first.items()} == {"rows": 5, "none": 0} and first["none"].columns == ["a"]
    with pytest.raises(packages.NotPublished, match="no version 9"):
        packages.read_package(spark, target, 9)
    assert packages.verify_package(spark, target).count() == packages.verify_package(spark, target, 1).count() == 0


def test_a_write_that_fails_midway(spark, tmp_path):
    target = str(tmp_path / "gold")
    packages.publish(spark, {"a": spark.range(3), "b": spark.range(4)}, target)
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        packages.publish(spark, {"a": spark.range(9), "b": bad}, target)
    assert {n: t.count() for n, t in packages.read_package(spark, target).items()} == {"a": 3, "b": 4}
    assert packages.publish(spark, {"a": spark.range(1)}, target) == 2


def test_two_publications_of_one_version(spark, tmp_path):
    target = str(tmp_path / "gold")
    packages.publish(spark, {"a": spark.range(3)}, target)
    with pytest.raises(packages.NotPublished, match="someone else"):
        packages._commit(spark, target, 1, "{}")
    assert packages.read_package(spark, target)["a"].count() == 3
    assert [p.name for p in pathlib.Path(target, "versions").iterdir() if not p.name.endswith(".crc")] == ["0000000001"]


def test_gate_stops_before_a_write(spark, tmp_path):
    target = tmp_path / "gold"
    faults = spark.createDataFrame([("m", "not_reviewed", "x", "unfrozen")], "movie string, code string, detail string, level string")
    with pytest.raises(packages.NotPublished, match="m: not_reviewed x"):
        packages.publish(spark, {"a": spark.range(3)}, str(target), faults)
    assert not target.exists()
    assert packages.publish(spark, {"a": spark.range(3)}, str(target), faults, force=True) == 1
    with pytest.raises(packages.NotPublished, match="lint:y"):
        packages.publish(spark, {"a": spark.range(3)}, str(target), spark.createDataFrame([("m", "lint:y", "1", "quality")], faults.schema), force=True)


def test_changed_files_are_found(spark, tmp_path):
    target = tmp_path / "gold"
    packages.publish(spark, {"a": spark.range(3).coalesce(1), "b": spark.range(3).coalesce(1), "c": spark.range(3).coalesce(1)}, str(target))
    files = {p.parent.name: p for p in target.glob("data/*/*/*.parquet")}
    files["a"].unlink()
    other = files["b"].read_bytes()
    files["b"].write_bytes(other[:-20] + b"x" + other[-19:])
    files["b"].with_name("more.parquet").write_bytes(other)
    for crc in target.glob("data/*/*/.*.crc"):
        crc.unlink()
    found = packages.verify_package(spark, str(target)).collect()
    assert sorted((r.path.split("/")[0], r.fault) for r in found) == [("a", "missing"), ("b", "added"), ("b", "changed")]


def joins_of(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_faults_send_no_table_to_every_task(spark):
    """the files of all movies are never a broadcast; Spark's guess of their size does not see the rows that a movie is exploded to."""
    m, files = spark.createDataFrame([("a",)], "movie string"), spark.createDataFrame([], FILES)
    found = spark.createDataFrame([("a", "x", "error")], "movie string, code string, severity string")
    assert joins_of(packages.package_faults(m, files)) == []
    joins = joins_of(packages.package_faults(m, files, found))
    assert len(joins) == 1 and "strategy=merge" in joins[0]


def test_verdicts_send_no_table_to_every_task(spark):
    """the counts of all movies are met by a sorted join."""
    m = spark.createDataFrame([("a",)], "movie string")
    faults = spark.createDataFrame([("a", "missing_file", "x", "missing")], "movie string, code string, detail string, level string")
    joins = joins_of(packages.package_verdicts(m, faults))
    assert joins and all("strategy=merge" in j for j in joins)
