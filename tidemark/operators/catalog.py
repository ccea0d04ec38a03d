"""Catalogs, queues, rosters and progress: operators around a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def even_indices(spans: DataFrame, lo: str, hi: str, n: int) -> DataFrame:
    """At most n frames evenly from lo to hi, both included; a span of fewer frames gives all of them."""
    size = F.col(hi) - F.col(lo) + 1
    count = F.least(F.lit(n).cast("long"), size)
    at = lambda i: F.col(lo) + F.floor(i * (size - 1) / F.greatest(count - 1, F.lit(1)))
    return spans.withColumn("frame", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), at)))


def roster(segments: DataFrame, claimed: DataFrame, present: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of each segment: claimed ones and those present in its day; a segment with none gets all of its story.

    segments: story, seg, day; claimed: story, seg, eid; present: story, day, eid; entities: story, eid.
    """
    found = claimed.select("story", "seg", "eid").unionByName(
        segments.join(present, ["story", "day"]).select("story", "seg", "eid")
    ).distinct()
    bare = segments.join(found.select("story", "seg").distinct(), ["story", "seg"], "left_anti")
    return found.unionByName(bare.join(entities, "story").select("story", "seg", "eid"))


def consistent_detections(detections: DataFrame, keys: list[str], min_frames: int, tolerance: int) -> DataFrame:
    """The best detection whose centre lies in a cell that ``min_frames`` frames agree on.

    Centres fall in cells of ``tolerance`` units, so that no pairs are made.
    """
    cell = [F.floor(F.col(c) / tolerance).alias(f"_{c}") for c in ("cx", "cy")]
    rows = detections.select("*", *cell)
    agreed = rows.groupBy(*keys, "_cx", "_cy").agg(
        F.countDistinct("frame").alias("n_frames"), F.max(F.struct("score", (-F.col("item")).alias("i"))).alias("b")
    ).where(F.col("n_frames") >= min_frames)
    return agreed.groupBy(*keys).agg(F.max(F.struct("b.score", "b.i", "n_frames")).alias("b")).select(
        *keys, (-F.col("b.i")).alias("item"), F.col("b.score").alias("score"), F.col("b.n_frames").alias("n_frames")
    )


def fleet(intents: DataFrame, instances: DataFrame, workloads: DataFrame, breaks: DataFrame, now: Column, stale_after: int) -> DataFrame:
    """One row a machine known to either side, its load and a status: on_break, missing, stale, busy or idle."""
    rows = intents.join(instances, "machine", "full_outer").join(workloads, "machine", "left").join(
        breaks.select("machine", F.lit(True).alias("_break")), "machine", "left"
    )
    status = (
        F.when(F.col("_break"), "on_break").when(F.col("heartbeat").isNull(), "missing")
        .when(now - F.col("heartbeat") > stale_after, "stale").when(F.coalesce("load", F.lit(0)) > 0, "busy").otherwise("idle")
    )
    return rows.withColumn("status", status).drop("_break")


def progress(schedule: DataFrame, results: DataFrame) -> DataFrame:
    """Segments done of each system; a finished run without a count of its own has done all that were scheduled."""
    rows = schedule.join(results, ["system", "story"], "left")
    done = F.when(F.col("own_done").isNotNull(), F.col("own_done")).when(F.col("state") == "DONE", F.col("n_segments")).otherwise(0)
    return rows.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("state") == "DONE").alias("n_done"), F.count_if(F.col("state").isNull()).alias("n_waiting"),
        F.sum("n_segments").alias("segments"), F.sum(done).cast("long").alias("segments_done"),
    )


def best_per_key(cards: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first card of each key in the given order."""
    return cards.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def manifest(rows: DataFrame, stratum: str, line: Column) -> DataFrame:
    """Counts of the strata, and a digest that does not depend on the order of the rows: a hash over sorted part hashes.

    Lines are hashed in 256 parts, so no task holds them all.
    """
    parts = rows.select(F.sha2(line, 256).alias("h"), F.col(stratum).alias("stratum"))
    digests = parts.withColumn("p", F.substring("h", 1, 2)).groupBy("p").agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    whole = digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", F.col("s").cast("string")))), ","), 256).alias("digest"))
    return parts.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(whole))
