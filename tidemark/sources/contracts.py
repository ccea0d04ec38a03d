"""Readers and writers of the JSON, CSV and vector contracts, with explicit schemas.

Reads are tolerant: missing fields are null, a legacy field is accepted under its
old name, and lines that aren't objects are dropped where the contract says so.
Writes go through Spark's committer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPRESENTATION = (
    "struct<representation_id:string,chunk_id:int,crop_path:string,bbox:array<int>,bbox_source:string,frame_index:int,"
    "embedding_key:string,state:string,qa:map<string,string>>"
)
ENTITY = (
    "struct<entity_id:string,kind:string,name:string,description:string,first_chunk:int,"
    f"representations:array<{REPRESENTATION}>,reps:array<{REPRESENTATION}>,"
    "state_events:array<struct<event_id:string,chunk_id:int,description:string,deprecates:array<string>,frame_index:int,seconds:double>>,"
    "static_attributes:map<string,string>,presence_spans:array<array<int>>,screen_time_seconds:double>"
)
REGISTRY = f"movie_id string, schema_version string, human_reviewed boolean, entities array<{ENTITY}>"
CHUNKS = (
    "movie_id string, schema_version string, chunks array<struct<chunk_id:int,shot_span:array<int>,frame_span:array<int>,seconds_span:array<double>,"
    "prompt:string,present:array<string>,first_appearances:array<string>,"
    "gold_instructions:array<struct<entity_id:string,requirement:string,note:string>>,"
    "forbidden:array<struct<representation_id:string,reason:string>>,scenario_tags:array<string>>>"
)
PROMPTS = "story_id string, segments array<struct<segment_id:string,duration_sec:double,transition:string,prompt:string>>"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with the file's path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def entities(registries: DataFrame) -> DataFrame:
    """A row for each entity; representations under their old name count as well."""
    rows = registries.select("movie_id", F.explode("entities").alias("e"))
    reps = F.coalesce("e.representations", "e.reps", F.array().cast(f"array<{REPRESENTATION}>"))
    return rows.withColumn("representations", reps).select(
        "movie_id", "e.entity_id", "e.kind", "e.name", "e.description", "e.first_chunk", "representations", "e.state_events",
        "e.static_attributes", "e.presence_spans", "e.screen_time_seconds",
    )


def gold_chunks(chunks: DataFrame) -> DataFrame:
    """A row for each chunk with ``continuity``: who is present and not new, in order, repeats kept."""
    rows = chunks.select("movie_id", F.explode("chunks").alias("c")).select("movie_id", "c.*")
    new = F.coalesce("first_appearances", F.array().cast("array<string>"))
    return rows.withColumn("continuity", F.filter("present", lambda x: ~F.array_contains(new, x)))


def prompt_segments(streams: DataFrame) -> DataFrame:
    """A row for each prompt, defaults filled in; an empty prompt raises."""
    rows = streams.select("story_id", F.posexplode("segments").alias("idx", "s"))
    prompt = F.when(F.trim(F.coalesce("s.prompt", F.lit(""))) == "", F.raise_error(F.lit("empty prompt")).cast("string")).otherwise(F.col("s.prompt"))
    return rows.select(
        "story_id", "idx", F.coalesce("s.segment_id", F.format_string("seg_%03d", F.col("idx") + 1)).alias("segment_id"),
        F.coalesce("s.transition", F.lit("cut")).alias("transition"), F.coalesce("s.duration_sec", F.lit(5.0)).alias("duration_sec"), prompt.alias("prompt"),
    )


def read_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; with ``tolerant``, lines that do not parse are left out, else they raise."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def latest_judgments(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The row of each key in the last file by name."""
    rows = spark.read.schema(schema).json(path).withColumn("_file", F.col("_metadata.file_path"))
    columns = [c for c in rows.columns if c not in (key, "_file")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_file").alias("r")).select(key, "r.*")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Closed-inclusive spans from CSV with a header."""
    return spark.read.schema("story string, start_frame long, end_frame long").option("header", True).csv(path)


def read_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Scores below root/baseline/dataset/sample/mode[/B<n>]; the parts of the path become columns."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "score.json").option("multiLine", True).json(root)
    parts = F.slice(F.split(F.col("_metadata.file_path"), "/"), -6, 6)
    with_budget = parts[4].rlike(r"^B\d+$")
    at = lambda k: F.when(with_budget, parts[k]).otherwise(parts[k + 1])
    return rows.withColumns(
        {"baseline": at(0), "dataset": at(1), "sample": at(2), "mode": at(3), "budget": F.when(with_budget, F.substring(parts[4], 2, 9).cast("int"))}
    ).where(~F.col("_metadata.file_path").rlike("_visual_score|pre_smoke_backup"))


def write_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def write_board(board: DataFrame, path: str, by: str) -> None:
    """A leaderboard, partitioned so that a baseline's rows can be replaced alone."""
    board.write.mode("overwrite").partitionBy(by).json(path)


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row of each key over both tables; write the result to a new version of the table."""
    both = existing.unionByName(changes, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")
