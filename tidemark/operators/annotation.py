"""Annotation-side operators: units, events, patches, conflicts, boundaries, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.lint import overlap


def identity_units(timeline: DataFrame, long_gap: int = 30) -> DataFrame:
    """A unit for each re-appearance: its previous appearance, states at both ends and stratum.

    timeline: story, idx, eid, state (nullable). The state in force includes the
    row's own; the previous one is that of the previous appearance.
    """
    own = Window.partitionBy("story", "eid").orderBy("idx")
    carried = F.last("state", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = timeline.withColumn("state_b", carried)
    rows = rows.withColumns({"prev_idx": F.lag("idx").over(own), "state_a": F.lag("state_b").over(own)})
    rows = rows.where(F.col("prev_idx").isNotNull()).withColumn("gap", F.col("idx") - F.col("prev_idx") - 1)
    changed = F.col("state_a").isNotNull() & F.col("state_b").isNotNull() & (F.col("state_a") != F.col("state_b"))
    stratum = (
        F.when(F.col("gap") == 0, "gap0").when(changed & (F.col("gap") >= long_gap), "transform_ge30").when(changed, "transform").otherwise("main")
    )
    return rows.withColumn("stratum", stratum)


def numbered_events(events: DataFrame, keys: list[str], base: str, order: list[str]) -> DataFrame:
    """``event_id``: the base id, with .n for the n-th repeat of it."""
    place = F.row_number().over(Window.partitionBy(*keys, base).orderBy(*order)) - 1
    return events.withColumn("event_id", F.when(place == 0, F.col(base)).otherwise(F.concat_ws(".", F.col(base), place.cast("string"))))


def deprecated_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """For every event, its entity's items made at or before it, as a sorted list.

    Items of an entity are joined by equality; an entity's items are few (its library is capped).
    """
    rows = events.join(items, ["story", "eid"], "left")
    return rows.groupBy("story", "eid", "event_id", "at").agg(
        F.array_sort(F.collect_set(F.when(F.col("made_at") <= F.col("at"), F.col("item")))).alias("deprecates")
    )


def remapped(presence: DataFrame, id_map: DataFrame) -> DataFrame:
    """Presence under new ids: merged ids fall together, dropped ones (null) vanish, the rest stay."""
    m = id_map.select("eid", F.struct("new_id").alias("_m"))
    rows = presence.join(m, "eid", "left")
    new = F.when(F.col("_m").isNull(), F.col("eid")).otherwise(F.col("_m.new_id"))
    return rows.withColumn("eid", new).where(F.col("eid").isNotNull()).drop("_m").distinct()


def refined_boundaries(similarities: DataFrame, candidates: DataFrame, keys: list[str], idx: str, similarity: str, radius: int, whole: float) -> DataFrame:
    """keys, candidate, refined, disruption: each candidate boundary moved to the sharpest break near it.

    ``similarities`` has, at idx, how alike frame idx and the next one are (``whole`` if they are the same).
    Of the places within ``radius`` of a candidate, the one that falls most below both
    its neighbours (``whole`` beyond the edges) is the break, the first of equals; the boundary
    is the frame after it. Places meet candidates by equality, ``2 * radius + 1`` each.
    """
    near = candidates.withColumn(idx, F.explode(F.sequence(F.col("candidate") - radius, F.col("candidate") + radius)))
    rows = similarities.select(*keys, idx, similarity).join(near.select(*keys, "candidate", idx), [*keys, idx])
    own = Window.partitionBy(*keys, "candidate").orderBy(idx)
    cur, edge = F.col(similarity), F.lit(whole)
    left, right = F.coalesce(F.lag(similarity).over(own), edge), F.coalesce(F.lead(similarity).over(own), edge)
    rows = rows.withColumn("disruption", F.greatest(F.lit(0), left - cur) + F.greatest(F.lit(0), right - cur))
    best = rows.groupBy(*keys, "candidate").agg(F.max(F.struct("disruption", (-F.col(idx)).alias("i"))).alias("b"))
    return best.select(*keys, "candidate", (1 - F.col("b.i")).alias("refined"), F.col("b.disruption").alias("disruption"))


def sharp_frames(frames: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k sharpest frames of each group, in time order."""
    best = Window.partitionBy(*keys).orderBy(F.desc("sharpness"), F.desc("contrast"), "t")
    rows = frames.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("t")))


def conflict_winners(crops: DataFrame, max_iou: float, margin: float) -> DataFrame:
    """``n_claims`` and ``kept`` of crops that several entities claim: of each conflict the best one stays if it leads by ``margin``, else none.

    crops: item (a number), chunk_id, frame, kind, path, box, score. Crops of one chunk,
    frame and kind conflict if they share their path or overlap by ``max_iou``, and through others
    that do; crops in no conflict stay.
    """
    group = ["chunk_id", "frame", "kind"]
    other = crops.select(*group, F.col("item").alias("o_item"), F.col("path").alias("o_path"), F.col("box").alias("o_box"))
    clash = (F.col("path") == F.col("o_path")) | (overlap(F.col("box"), F.col("o_box")) >= max_iou)
    edges = crops.join(other, group).where((F.col("item") < F.col("o_item")) & clash).select(F.col("item").alias("u"), F.col("o_item").alias("v"))
    parts = components(edges).withColumnsRenamed({"node": "item", "component": "conflict"})
    rows = crops.join(parts, "item", "left")
    own = Window.partitionBy("conflict")
    claimed = rows.where(F.col("conflict").isNotNull()).withColumns(
        {"n_claims": F.count(F.lit(1)).over(own), "_r": F.row_number().over(own.orderBy(F.desc("score"), "item")), "_next": F.lead("score").over(own.orderBy(F.desc("score"), "item"))}
    )
    claimed = claimed.withColumn("kept", (F.col("_r") == 1) & (F.col("score") - F.col("_next") >= margin)).drop("_r", "_next")
    free = rows.where(F.col("conflict").isNull()).withColumns({"n_claims": F.lit(1).cast("long"), "kept": F.lit(True)})
    return claimed.withColumn("kept", F.coalesce("kept", F.lit(False))).unionByName(free)


def parity(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per key: which fields agree (nulls too), whether both sides have it, and whether all is equal."""
    left = a.select(*keys, F.struct(*fields).alias("_a"))
    right = b.select(*keys, F.struct(*fields).alias("_b"))
    rows = left.join(right, keys, "full_outer")
    same = [F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")) for f in fields]
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    n: Column = sum((s.cast("int") for s in same), F.lit(0))
    return rows.select(*keys, both.alias("in_both"), F.when(both, n).otherwise(0).alias("n_equal"), (both & (n == len(fields))).alias("all_equal"))


def capped_payload(items: DataFrame, keys: list[str], per_entity: int, total: int) -> DataFrame:
    """At most ``per_entity`` items of each entity while a total lasts: first appearances first, then by id."""
    own = Window.partitionBy(*keys, "eid").orderBy(F.desc("quality"), "item")
    rows = items.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= per_entity)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("is_first").cast("int")), "eid", "_r")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total).drop("_r")


def weighted_order(items: DataFrame, item: str, weight: Column, seed: str, k: int) -> DataFrame:
    """k items drawn without replacement by weight: those of least -ln(u)/w, u from a keyed hash."""
    u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")), 256), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return items.withColumn("priority", F.round(-F.log(u) / weight, 9)).orderBy("priority", item).limit(k)
