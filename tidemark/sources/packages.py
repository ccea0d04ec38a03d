"""Packages: several tables published together, all or nothing, with the hash of every file.

A package is a folder. ``data/<name>`` holds the tables of one publication, and
``versions/<number>`` says that it is complete; that file is moved into its place in one
step after everything else was written. A publication that fails before leaves only
a folder that no reader looks at, so readers go on with the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files that a package must ship, and those of them that are documents with a version; fixed by the contract.
REQUIRED = ("manifest.json", "gold/chunk_index.json", "gold/shot_boundaries.csv", "gold/entity_registry.json", "gold/chunk_annotations.json")
VERSIONED = ("gold/chunk_index.json", "gold/entity_registry.json", "gold/chunk_annotations.json")
LAYOUT = "gold/chunk_index.json"
REVIEWED = ("gold/entity_registry.json", "gold/chunk_annotations.json")


class NotPublished(Exception):
    """A package was not written; the text says why."""


def package_faults(movies: DataFrame, files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """movie, code, detail, level: what keeps movies from being published.

    ``files`` (movie, file, schema_version, layout_hash, human_reviewed) lists the files
    there are; repeated rows count once. Levels are ``missing`` (a required file),
    ``quality`` (no schema version, versions that differ within a movie, no layout hash,
    an error among the lint ``findings``) and ``unfrozen`` (not reviewed by a human).
    """
    # What is asked for and what is there are counted together: no side is small enough to be sent to every task.
    asked = movies.select("movie").distinct().select("movie", F.explode(F.array(*map(F.lit, REQUIRED))).alias("file"), F.lit(True).alias("asked"))
    given = files.where(F.col("movie").isNotNull() & F.col("file").isin(*REQUIRED)).select(
        "movie", "file", "schema_version", "layout_hash", F.coalesce("human_reviewed", F.lit(False)).alias("human_reviewed"), F.lit(False).alias("asked")
    )
    rows = given.unionByName(asked, allowMissingColumns=True).groupBy("movie", "file").agg(
        F.max("schema_version").alias("high"), F.min("schema_version").alias("low"), F.max("layout_hash").alias("layout"), F.bool_and("human_reviewed").alias("reviewed"),
        F.bool_or(~F.col("asked")).alias("there"), F.bool_or("asked").alias("asked"),
    ).where("asked")
    there, file = F.coalesce("there", F.lit(False)), F.col("file")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    fault = lambda when, code, level: F.when(when, F.struct(F.lit(code).alias("code"), file.alias("detail"), F.lit(level).alias("level")))
    own = F.array_compact(
        F.array(
            fault(~there, "missing_file", "missing"),
            fault(there & file.isin(*VERSIONED) & blank("high"), "missing_schema_version", "quality"),
            fault(there & (file == LAYOUT) & blank("layout"), "missing_layout_hash", "quality"),
            fault(there & file.isin(*REVIEWED) & ~F.coalesce("reviewed", F.lit(False)), "not_reviewed", "unfrozen"),
        )
    )
    found = rows.select("movie", F.explode(own).alias("f")).select("movie", "f.*")
    versions = rows.where(file.isin(*VERSIONED) & ~blank("high")).groupBy("movie").agg(F.min(F.nullif("low", F.lit(""))).alias("low"), F.max("high").alias("high"))
    differ = versions.where("low <> high").select("movie", F.lit("schema_version_mismatch").alias("code"), F.concat_ws(" / ", "low", "high").alias("detail"), F.lit("quality").alias("level"))
    found = found.unionByName(differ)
    if findings is not None:
        known = movies.select("movie").distinct().hint("merge")
        errors = findings.where("severity = 'error'").groupBy("movie", "code").count().join(known, "movie", "left_semi")
        found = found.unionByName(errors.select("movie", F.concat(F.lit("lint:"), "code").alias("code"), F.col("count").cast("string").alias("detail"), F.lit("quality").alias("level")))
    return found


def package_verdicts(movies: DataFrame, faults: DataFrame, force: bool = False) -> DataFrame:
    """movie, n_missing, n_quality, n_unfrozen, outcome: published, unfrozen, quality or missing, the gravest first; ``force`` lets unfrozen movies pass."""
    count = lambda level: F.coalesce(F.count_if(F.col("level") == level), F.lit(0))
    counts = faults.groupBy("movie").agg(count("missing").alias("n_missing"), count("quality").alias("n_quality"), count("unfrozen").alias("n_unfrozen"))
    rows = movies.select("movie").distinct().join(counts.hint("merge"), "movie", "left").fillna(0, ["n_missing", "n_quality", "n_unfrozen"])
    outcome = F.when(F.col("n_missing") > 0, "missing").when(F.col("n_quality") > 0, "quality").when((F.col("n_unfrozen") > 0) & F.lit(not force), "unfrozen").otherwise("published")
    return rows.withColumn("outcome", outcome)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str) -> list[int]:
    folder, fs = _files(spark, f"{target}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _commit(spark: SparkSession, target: str, version: int, text: str) -> None:
    """Put the version's file in its place by one rename, which fails if another publication was first."""
    jvm = spark._jvm
    draft, fs = _files(spark, f"{target}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), fs.getConf())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{target}/versions/{version:010d}"), options)
    except Exception as e:
        fs.delete(draft, False)
        raise NotPublished(f"version {version} of {target} was published by someone else") from e


def file_sums(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, sha256 of the data files below a folder; each file is hashed in the task that reads it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    root = f"/{folder.rstrip('/').rsplit('/', 1)[1]}/"
    return found.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str, faults: DataFrame | None = None, force: bool = False) -> int:
    """Write the tables as the next version of the package at ``target`` and return its number.

    Faults, as ``package_faults`` gives them, stop it before anything is written; with
    ``force`` those of level ``unfrozen`` don't. A table's null and empty rows are kept as
    they are. If a write fails, readers see the version before.
    """
    if faults is not None:
        stop = faults.where("level <> 'unfrozen'") if force else faults
        first = stop.orderBy("movie", "code", "detail").limit(20).collect()
        if first:
            raise NotPublished("; ".join(f"{r.movie}: {r.code} {r.detail}" for r in first))
    target = target.rstrip("/")
    version = max(_versions(spark, target), default=0) + 1
    name = f"{version:010d}-{uuid.uuid4().hex}"
    folder = f"{target}/data/{name}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}")
    file_sums(spark, folder).write.parquet(f"{target}/sums/{name}")
    _commit(spark, target, version, json.dumps({"version": version, "data": name, "tables": sorted(tables)}))
    return version


def _manifest(spark: SparkSession, target: str, version: int | None) -> dict:
    known = _versions(spark, target)
    if not known or (version is not None and version not in known):
        raise NotPublished(f"{target} has no version {version or ''}".rstrip())
    where, fs = _files(spark, f"{target}/versions/{version or known[-1]:010d}")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_package(spark: SparkSession, target: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last one if none is named, all of the same publication."""
    target = target.rstrip("/")
    m = _manifest(spark, target, version)
    return {t: spark.read.parquet(f"{target}/data/{m['data']}/{t}") for t in m["tables"]}


def verify_package(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """path, fault (missing, changed or added) of the files that are not as published; no rows if all is well."""
    target = target.rstrip("/")
    m = _manifest(spark, target, version)
    told = spark.read.parquet(f"{target}/sums/{m['data']}").select("path", F.struct("size", "sha256").alias("told"))
    found = file_sums(spark, f"{target}/data/{m['data']}").select("path", F.struct("size", "sha256").alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "added").when(F.col("told") != F.col("found"), "changed")
    return told.join(found, "path", "full").select("path", fault.alias("fault")).where("fault IS NOT NULL")
