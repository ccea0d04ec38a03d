"""What systems selected for each chunk, as nested documents and as rows; annotations of unfinished work; scores of segments as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import CHUNKS, REGISTRY, read_documents

REP = "struct<name:string,kind:string,crop_path:string,crop_abspath:string,source_seconds:double>"
ITEM = f"struct<asset_id:string,representations:array<{REP}>>"
SELECTIONS = f"movie string, system string, chunks array<struct<chunk_id:int,prompt:string,selected:array<{ITEM}>,retrieval_timing:map<string,double>>>"
KEY = ("movie", "system")

#: Columns of the table of segments after movie and system, fixed by the contract.
SEGMENT = (
    "segment_id", "sec_start", "sec_end", "dur_s", "n_refs", "n_present", "n_continuity", "precision", "recall", "recall_all", "f1",
    "redun_vlm", "redun_sim", "sel_eff", "retrieval_ms", "write_ms", "score_ms",
)


def prefer(new: DataFrame, legacy: DataFrame) -> DataFrame:
    """Documents of the new layout, and those of the old one whose movie and system have none there."""
    return new.unionByName(legacy.join(new.select(*KEY).distinct(), list(KEY), "left_anti"))


def selected_images(documents: DataFrame) -> DataFrame:
    """movie, system, chunk_id, images, timing of each chunk of the selections.

    An image is a struct of ``path`` (the absolute one, else the relative one) and
    ``seconds``, which is set only where a frame of the video must be cut for want of a
    path. Representations with neither are left out; a chunk without images keeps its
    row. Where a chunk's id repeats in a document, its last place counts.
    """
    rows = documents.select(*KEY, F.posexplode("chunks").alias("at", "c"))
    none = F.array().cast(f"array<{REP}>")
    reps = F.flatten(F.transform(F.coalesce("c.selected", F.array().cast(f"array<{ITEM}>")), lambda s: F.coalesce(s["representations"], none)))

    def image(r):
        path = F.when(F.coalesce(r["crop_abspath"], F.lit("")) != "", r["crop_abspath"]).otherwise(r["crop_path"])
        return F.struct(path.alias("path"), F.when(path.isNull(), r["source_seconds"]).alias("seconds"))

    images = F.filter(F.transform(reps, image), lambda i: (F.coalesce(i["path"], F.lit("")) != "") | i["seconds"].isNotNull())
    timing = F.coalesce("c.retrieval_timing", F.create_map().cast("map<string,double>"))
    last = rows.groupBy(*KEY, F.col("c.chunk_id").alias("chunk_id")).agg(F.max_by(F.struct(images.alias("images"), timing.alias("timing")), "at").alias("r"))
    return last.select(*KEY, "chunk_id", "r.*")


def selection_documents(rows: DataFrame) -> DataFrame:
    """movie, system, document: the selections of a system for a movie as JSON text, the inverse of ``selected_images``.

    ``rows`` has a row for each representation: movie, system, chunk_id, prompt, item (its
    place in the chunk), asset_id, place (its own in the item), name, kind, crop_path,
    crop_abspath, source_seconds. A row without an item stands for a chunk where nothing
    was selected. A document gathers its movie, as its contract has it.
    """
    own = F.struct("name", "kind", "crop_path", "crop_abspath", "source_seconds")
    items = rows.groupBy(*KEY, "chunk_id", "item", "asset_id").agg(F.max("prompt").alias("prompt"), F.array_sort(F.collect_list(F.struct("place", own.alias("r")))).alias("reps"))
    item = F.struct("item", "asset_id", F.transform("reps", lambda r: r["r"]).alias("representations"))
    chunks = items.groupBy(*KEY, "chunk_id").agg(F.max("prompt").alias("prompt"), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), item))).alias("items"))
    selected = F.transform("items", lambda i: F.struct(i["asset_id"].alias("asset_id"), i["representations"].alias("representations")))
    whole = chunks.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("prompt", F.lit("")).alias("prompt"), selected.alias("selected")))).alias("chunks"))
    return whole.select(*KEY, F.to_json(F.struct(*KEY, "chunks")).alias("document"))


def read_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """movie_id, schema_version, human_reviewed (always false), chunks of the unfinished annotations below a folder.

    A movie's ``checkpoint.json`` takes its missing id and its schema version from the
    ``checkpoint_registry.json`` beside it; one without that file is left out.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)

    def found(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
        return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("folder", folder)

    work = found("checkpoint.json", CHUNKS).select("folder", F.col("movie_id").alias("own"), F.coalesce("chunks", F.from_json(F.lit("[]"), CHUNKS.split("chunks ", 1)[1])).alias("chunks"))
    names = found("checkpoint_registry.json", REGISTRY).select("folder", "movie_id", "schema_version")
    return work.join(names, "folder").select(F.coalesce("own", "movie_id").alias("movie_id"), "schema_version", F.lit(False).alias("human_reviewed"), "chunks")


def write_segments(scores: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header below system=.../: a row a segment in the order of movies and their time; columns the scores lack are empty."""
    have = {c: F.col(c) if c in scores.columns else F.lit(None).cast("double").alias(c) for c in SEGMENT}
    rows = scores.select(*KEY, *have.values()).repartitionByRange("system", "movie", "segment_id").sortWithinPartitions("system", "movie", "segment_id")
    rows.write.mode(mode).option("header", True).partitionBy("system").csv(path)


def read_selections(spark: SparkSession, new: str, legacy: str | None = None) -> DataFrame:
    """Documents of selections, those of the new layout first."""
    rows = read_documents(spark, new, SELECTIONS)
    return rows if legacy is None else prefer(rows, read_documents(spark, legacy, SELECTIONS))
