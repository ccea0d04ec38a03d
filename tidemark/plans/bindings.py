"""Bindings of the model's tables to the driver's, as DataFrames and as SQL for the oracle.

A story is a user; its segments are the user's events in order; entities are the
event types; a state is the hundreds of the event's value; clips last value / 10
seconds. Each DataFrame has its SQL twin below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story, idx, eid, kind, value, sec (whole seconds), event_id."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("story"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.col("event_type").alias("eid"),
        F.when(F.col("event_type").isin("view", "click"), "character").when(F.col("event_type") == "error", "prop").otherwise("location").alias("kind"),
        "value",
        F.unix_timestamp("ts").alias("sec"),
        "event_id",
    )


TIMELINE = """tl AS (
  SELECT user_id AS story, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
         event_type AS eid, CASE WHEN event_type IN ('view', 'click') THEN 'character' WHEN event_type = 'error' THEN 'prop' ELSE 'location' END AS kind,
         value, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id FROM events)"""
GAPS = """gp AS (
  SELECT *, lag(idx) OVER (PARTITION BY story, eid ORDER BY idx) AS last_seen,
         idx - lag(idx) OVER (PARTITION BY story, eid ORDER BY idx) - 1 AS gap FROM tl)"""


def stateful(rows: DataFrame) -> DataFrame:
    """``state`` of some appearances: the value's band, null where the value's whole part is odd."""
    whole = F.floor("value").cast("long")
    return rows.withColumn("state", F.when(whole % 2 == 0, F.concat(F.lit("s"), (F.floor(F.col("value") / 50)).cast("string"))))


STATE = "CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 's' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) END AS state"


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story, idx (day of the month from 0), eid, kind: distinct entities of each day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("story"),
        (F.dayofmonth("ts") - 1).cast("long").alias("idx"),
        F.col("event_type").alias("eid"),
        F.when(F.col("event_type").isin("view", "click"), "character").when(F.col("event_type") == "error", "prop").otherwise("location").alias("kind"),
    ).distinct()


PRESENCE = """pr AS (
  SELECT DISTINCT user_id AS story, CAST(day(ts) - 1 AS BIGINT) AS idx, event_type AS eid,
         CASE WHEN event_type IN ('view', 'click') THEN 'character' WHEN event_type = 'error' THEN 'prop' ELSE 'location' END AS kind FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged cast rows: gap, op by gap, and a verdict that abstains on every seventh event."""
    from tidemark.operators.timeline import gaps

    g = gaps(timeline(spark, sf_dir))
    op = F.when(F.col("gap").isNull(), "introduce").when(F.col("gap") == 0, "persist").when(F.col("gap") >= 30, "recall_after_gap").otherwise("recall")
    hit = F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("long") % 3 != 0)
    return g.withColumn("op", op).withColumn("hit", hit)


FACTS = """fx AS (
  SELECT *, CASE WHEN gap IS NULL THEN 'introduce' WHEN gap = 0 THEN 'persist' WHEN gap >= 30 THEN 'recall_after_gap' ELSE 'recall' END AS op,
         CASE WHEN event_id % 7 != 0 THEN CAST(floor(value) AS BIGINT) % 3 != 0 END AS hit FROM gp)"""
