"""Ordered-sequence operators over (story, idx, eid) timelines.

Windows are partitioned by story and entity, so cost follows the longest story,
not the table. A first appearance has a null gap and last_seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG_GAP = 30
AVOID_WINDOW = 4


def gaps(timeline: DataFrame) -> DataFrame:
    """``last_seen`` and ``gap`` (segments between two appearances) of every row."""
    own = Window.partitionBy("story", "eid").orderBy("idx")
    return timeline.withColumn("last_seen", F.lag("idx").over(own)).withColumn(
        "gap", F.col("idx") - F.col("last_seen") - 1
    )


def memory_ops(timeline: DataFrame) -> DataFrame:
    """``carried`` (latest state before) and ``op`` of every appearance; needs ``state`` (nullable)."""
    before = Window.partitionBy("story", "eid").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("state", ignorenulls=True).over(before)
    rows = gaps(timeline).withColumn("carried", carried)
    changed = F.col("state").isNotNull() & F.col("carried").isNotNull() & (F.col("state") != F.col("carried"))
    return rows.withColumn(
        "op",
        F.when(F.col("gap").isNull(), "introduce")
        .when(changed, "transform")
        .when(F.col("gap") == 0, "persist")
        .when(F.col("gap") >= LONG_GAP, "recall_after_gap")
        .otherwise("recall"),
    )


def forbidden_after(removals: DataFrame, segments: DataFrame, window: int = AVOID_WINDOW) -> DataFrame:
    """Entities removed at an earlier segment, for the next ``window`` segments.

    ``removals``: story, eid, at; ``segments``: story, idx. The range is joined on
    exploded positions, an equi join of bounded fan-out.
    """
    due = removals.select("story", "eid", "at", F.explode(F.sequence(F.col("at") + 1, F.col("at") + window)).alias("idx"))
    return (
        segments.join(due, ["story", "idx"])
        .groupBy("story", "idx", "eid")
        .agg(F.max("at").alias("removed_at"))
        .withColumn("since", F.col("idx") - F.col("removed_at"))
    )


def islands(spans: DataFrame, keys: list[str], lo: str, hi: str, adjacent: int = 0) -> DataFrame:
    """Merged spans: a span joins those before it that reach ``lo - adjacent`` or further.

    adjacent=1 merges closed-inclusive integer spans that overlap or adjoin;
    adjacent=0 merges half-open ones that overlap or touch.
    """
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col(lo) - adjacent) > reach, F.lit(True)).cast("int")
    numbered = spans.withColumn("_s", starts).withColumn(
        "_island", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "_island").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n_spans")
    ).drop("_island")


def span_metadata(spans: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Union duration, first, last and largest gap of half-open spans."""
    merged = islands(spans, keys, lo, hi)
    order = Window.partitionBy(*keys).orderBy(lo)
    return (
        merged.withColumn("_gap", F.lead(lo).over(order) - F.col(hi))
        .groupBy(*keys)
        .agg(
            F.sum(F.col(hi) - F.col(lo)).alias("covered"),
            F.min(lo).alias("first_at"),
            F.max(hi).alias("last_at"),
            F.coalesce(F.max("_gap"), F.lit(0)).alias("max_gap"),
            F.count(F.lit(1)).alias("n_islands"),
        )
    )


def first_appearances(timeline: DataFrame) -> DataFrame:
    """``first_idx`` of every row's entity, and whether the row is there."""
    own = Window.partitionBy("story", "eid")
    rows = timeline.withColumn("first_idx", F.min("idx").over(own))
    return rows.withColumn("is_first", F.col("idx") == F.col("first_idx"))


def reappearance_tags(presence: DataFrame) -> DataFrame:
    """Sorted tags of every segment: which kinds return after an absence; ['none'] if none does."""
    tagged = gaps(presence).withColumn(
        "tag", F.when(F.col("gap") >= 1, F.concat(F.lit("return_"), F.col("kind")))
    )
    tags = F.array_sort(F.collect_set("tag"))
    return tagged.groupBy("story", "idx").agg(
        F.when(F.size(tags) > 0, F.array_join(tags, ",")).otherwise("none").alias("tags")
    )


def coverage_selection(presence: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` segments of each entity: its first, every return after a gap, then evenly spaced fills."""
    rows = gaps(presence)
    own = Window.partitionBy("story", "eid")
    must = F.col("gap").isNull() | (F.col("gap") > 0)
    rows = rows.withColumn("must", must).withColumn("n_must", F.sum(F.col("must").cast("long")).over(own))
    fill = Window.partitionBy("story", "eid", "must").orderBy("idx")
    rows = rows.withColumn("pos", F.row_number().over(fill) - 1).withColumn("n_fill", F.count(F.lit(1)).over(own) - F.col("n_must"))
    room = F.greatest(F.lit(0), F.lit(cap) - F.col("n_must"))
    # Of n fills, the places round(i * (n - 1) / (room - 1)) for i = 0 .. room - 1, halves to the even one; all of them if there is room.
    step = (F.col("n_fill") - 1) / F.greatest(room - 1, F.lit(1))
    near = F.floor(F.try_divide("pos", step))
    at = lambda i: (i >= 0) & (i < room) & (F.bround(i * step) == F.col("pos"))
    spaced = F.when(F.col("n_fill") <= room, F.lit(True)).otherwise(at(near) | at(near + 1))
    rows = rows.where(F.col("must") | spaced).withColumn(
        "rank", F.row_number().over(own.orderBy("idx"))
    )
    return rows.where(F.col("rank") <= cap).select("story", "eid", "idx", "must", "rank")


def running_clock(clips: DataFrame, duration: str) -> DataFrame:
    """Start and end of each clip on its story's clock."""
    order = Window.partitionBy("story").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(duration).over(order)
    return clips.withColumn("clock_end", end).withColumn("clock_start", F.col("clock_end") - F.col(duration))


def closed_prefix(segments: DataFrame, ok: str) -> DataFrame:
    """The longest prefix of consecutive segments (from 0) whose status is ok."""
    own = Window.partitionBy("story")
    place = F.row_number().over(own.orderBy("idx")) - 1
    rows = segments.withColumn("_bad", ~F.col(ok) | (F.col("idx") != place))
    first_bad = F.min(F.when(F.col("_bad"), F.col("idx"))).over(own)
    return rows.withColumn("_first", first_bad).where(F.col("_first").isNull() | (F.col("idx") < F.col("_first"))).drop("_bad", "_first")


def rank_cut(items: DataFrame, keys: list[str], score: str, place: str, budget: int) -> DataFrame:
    """The ``budget`` best of each group: scored ones first, by score, then in their original order."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(place))
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)


def horizon_thirds(segments: DataFrame, weight: str) -> DataFrame:
    """early, mid or late by the share of the story's duration that lies before the segment."""
    own = Window.partitionBy("story")
    before = F.coalesce(F.sum(weight).over(own.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = before / F.nullif(F.sum(weight).over(own), F.lit(0.0))
    third = F.when(share * 3 < 1, "early").when(share * 3 < 2, "mid").otherwise("late")
    return segments.withColumn("third", F.coalesce(third, F.lit("early")))


def spans_from_boundaries(boundaries: DataFrame, at: str) -> DataFrame:
    """Half-open spans between consecutive distinct boundaries."""
    order = Window.partitionBy("story").orderBy(at)
    return boundaries.select("story", at).distinct().withColumn("span_end", F.lead(at).over(order)).where(
        F.col("span_end").isNotNull()
    )


def spaced_boundaries(boundaries: DataFrame, at: str, min_len: int) -> DataFrame:
    """Boundaries at least ``min_len`` after the one kept before: a fold over each story's sorted array.

    The array holds one story's boundaries only.
    """
    kept = F.aggregate(
        F.array_sort(F.collect_set(at)),
        F.expr("cast(array() as array<bigint>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) < min_len), acc).otherwise(
            F.concat(acc, F.array(x.cast("long")))
        ),
    )
    return boundaries.groupBy("story").agg(kept.alias("kept")).select("story", F.explode("kept").alias(at))


def sample_times(spans: DataFrame, lo: str, hi: str, fps: float) -> DataFrame:
    """Times in [lo, hi): the first half a step in (or mid-span if shorter), then every 1/fps; an empty span gives lo."""
    step = 1.0 / fps
    length = F.col(hi) - F.col(lo)
    first = F.col(lo) + F.least(F.lit(step / 2), length / 2)
    n = F.floor((F.col(hi) - 1e-6 - first) / step)
    times = F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.round(first + i * step, 3))).otherwise(
        F.array(F.round(F.col(lo).cast("double"), 3))
    )
    return spans.withColumn("t", F.explode(times))


def greedy_groups(items: DataFrame, keys: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Consecutive items in groups of at most ``budget`` characters, separators counted; one long item stays alone."""
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))),
        F.expr("named_struct('used', cast(0 as int), 'groups', cast(array() as array<int>))"),
        lambda a, x: F.when(
            (F.size(a["groups"]) > 0) & (a["used"] + 1 + x["n"] <= budget),
            F.struct((a["used"] + 1 + x["n"]).alias("used"), F.concat(F.slice(a["groups"], 1, F.size(a["groups"]) - 1), F.array(F.element_at(a["groups"], -1) + 1)).alias("groups")),
        ).otherwise(F.struct(x["n"].alias("used"), F.concat(a["groups"], F.array(F.lit(1))).alias("groups"))),
        lambda a: a["groups"],
    )
    return items.groupBy(*keys).agg(folded.alias("g")).select(*keys, F.posexplode("g").alias("group_no", "n_items"))


def event_chunks(events: DataFrame, chunks: DataFrame, at: str) -> DataFrame:
    """The chunk [lo, hi) that holds ``at``; before the first chunk the first, else (holes too) the last.

    Chunks are sorted and don't overlap, so the chunk is the latest that starts
    at or before the point: one pass over the union of both, no range join.
    """
    story = Window.partitionBy("story")
    marks = chunks.select("story", F.col("lo").alias("_at"), F.struct("chunk_id", "lo", "hi").alias("_c"), F.lit(0).alias("_o"))
    points = events.withColumn("_at", F.col(at)).withColumn("_c", F.lit(None).cast(marks.schema["_c"].dataType)).withColumn("_o", F.lit(1))
    rows = points.unionByName(marks, allowMissingColumns=True)
    order = story.orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "_hit": F.last("_c", ignorenulls=True).over(order),
            "_first": F.min("_c").over(story),
            "_last": F.max("_c").over(story),
        }
    ).where("_o = 1")
    inside = F.col("_hit").isNotNull() & (F.col(at) < F.col("_hit.hi"))
    chunk = F.when(inside, F.col("_hit.chunk_id")).when(F.col(at) < F.col("_first.lo"), F.col("_first.chunk_id")).otherwise(F.col("_last.chunk_id"))
    return rows.withColumn("chunk_id", chunk).drop("_at", "_c", "_o", "_hit", "_first", "_last")
