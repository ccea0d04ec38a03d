"""Nested documents as flat, ordered segments: annotations with scenes, and author sources whose actions are texts or objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.postprocess import field, items, kind_of, number, segments, string

EVENTS = "array<variant>"


def flat_segments(annotations: DataFrame) -> DataFrame:
    """movie, idx, start, end_, action, audio, present, loc_id of each segment (movie, doc) in the order of time.

    A missing start is 0 and a missing end the start; ends before starts change places.
    """
    seg = F.col("segment")
    rows = segments(annotations)
    a = F.coalesce("start", F.lit(0.0))
    b = F.coalesce("end_", a)
    rows = rows.select(
        "movie", F.least(a, b).alias("start"), F.greatest(a, b).alias("end_"), F.coalesce(string(field(seg, "action")), F.lit("")).alias("action"),
        F.coalesce(string(field(seg, "dialogue_or_audio")), F.lit("")).alias("audio"), F.transform(items(field(seg, "present_entity_ids")), string).alias("present"), "loc_id", "scene", "at",
    )
    order = Window.partitionBy("movie").orderBy("start", "end_", "scene", "at")
    return rows.withColumn("idx", F.row_number().over(order) - 1).drop("scene", "at")


def flat_actions(sources: DataFrame) -> DataFrame:
    """story, idx, scene_id, action, present, transition, events of each action of the sources (story, doc), in order.

    An action is a text, which takes its scene's presence, or an object that may
    have presence and events of its own; a scene's events stand before those of the
    action they name by ``at``. The first action of a scene is a cut.
    """
    scenes = sources.select("story", F.posexplode(items(field(F.col("doc"), "scenes"))).alias("scene", "s"))
    s, item = F.col("s"), F.col("item")
    rows = scenes.select("story", "scene", "s", F.posexplode(items(field(s, "actions"))).alias("local", "item"))
    is_text = kind_of(item) == "string"
    has = lambda name: ~is_text & (kind_of(field(item, name)) != "null")
    texts = lambda v: F.transform(items(v), string)
    of_scene = F.filter(items(field(s, "events")), lambda e: F.coalesce(number(field(e, "at")), F.lit(0.0)).cast("int") == F.col("local"))
    none = F.array().cast(EVENTS)
    own: Column = F.when(is_text, none).otherwise(items(field(item, "events")))
    rows = rows.select(
        "story", "scene", "local", string(field(s, "id")).alias("scene_id"),
        F.trim(F.when(is_text, string(item)).otherwise(string(field(item, "action")))).alias("action"),
        F.when(has("present"), texts(field(item, "present"))).otherwise(texts(field(s, "present"))).alias("present"),
        F.when(F.col("local") == 0, "cut").otherwise("continue").alias("transition"), F.concat(of_scene, own).alias("events"),
    )
    order = Window.partitionBy("story").orderBy("scene", "local")
    return rows.withColumn("idx", F.row_number().over(order) - 1).drop("scene", "local")


def source_faults(sources: DataFrame) -> DataFrame:
    """story, scene_id, fault: scenes without actions, and events that name no action of their scene."""
    scenes = sources.select("story", F.explode(items(field(F.col("doc"), "scenes"))).alias("s"))
    s = F.col("s")
    n = F.size(items(field(s, "actions")))
    at = lambda e: F.coalesce(number(field(e, "at")), F.lit(0.0)).cast("int")
    off = F.size(F.filter(items(field(s, "events")), lambda e: (at(e) < 0) | (at(e) >= n)))
    faults = F.array_compact(F.array(F.when(n == 0, "no_actions"), F.when((n > 0) & (off > 0), "event_out_of_range")))
    return scenes.select("story", string(field(s, "id")).alias("scene_id"), F.explode(faults).alias("fault"))
