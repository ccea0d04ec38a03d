"""A human study's sample: quotas by stratum with fallbacks, known inclusion probabilities, repeats, practice.

pool: system, stratum and the columns ``key`` that name a unit. Draws go by a keyed hash of
these, so they don't depend on how rows are partitioned, and reruns agree. Equal keys are equal
draws: a repeated unit is several units side by side. A null system is a system, a null stratum is never drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *columns: str) -> Column:
    """A hash of the columns (null as an empty text) by which they are shuffled."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def _segments(pool: DataFrame, quotas: list[tuple[str, int]], fallback: dict[str, str]) -> DataFrame:
    """system, stratum, for_stratum, quota, lo, hi, taken, pool_n: the ranks that each stratum takes from its own pool and its fallback's.

    One row for each system and quota at most twice; only counts are shuffled.
    """
    order = {name: k for k, (name, _) in enumerate(quotas)}
    for name, other in fallback.items():
        if name in order and order.get(other, len(order)) >= order[name]:
            raise ValueError(f"{other} must come before {name}, which falls back on it")
    counts = pool.where(F.col("stratum").isin(list(order))).groupBy("system", "stratum").agg(F.count(F.lit(1)).alias("pool_n"))
    plan = F.array(*[F.struct(F.lit(s).alias("for_stratum"), F.lit(n).cast("long").alias("quota"), F.lit(order[s]).alias("place"), F.lit(fallback.get(s)).cast("string").alias("other")) for s, n in quotas])
    asked = pool.select("system").distinct().select("system", F.explode(plan).alias("p")).select("system", "p.*")
    had = counts.select(F.col("system").alias("_s"), F.col("stratum").alias("for_stratum"), F.col("pool_n").alias("had"))
    asked = asked.join(had, asked["system"].eqNullSafe(had["_s"]) & (asked["for_stratum"] == had["for_stratum"]), "left").select(asked["*"], F.coalesce("had", F.lit(0)).alias("had"))
    own = asked.select("system", F.col("for_stratum").alias("stratum"), "for_stratum", "quota", "place", F.col("quota").alias("want"))
    rest = asked.where((F.col("had") < F.col("quota")) & F.col("other").isNotNull()).select(
        "system", F.col("other").alias("stratum"), "for_stratum", "quota", "place", (F.col("quota") - F.col("had")).alias("want")
    )
    of_pool = Window.partitionBy("system", "stratum")
    hi = F.sum("want").over(of_pool.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = own.unionByName(rest).withColumns({"hi": hi, "lo": hi - F.col("want"), "_all": F.sum("want").over(of_pool)})
    counts = counts.withColumnsRenamed({"system": "_s", "stratum": "_t"})
    rows = rows.join(counts, rows["system"].eqNullSafe(counts["_s"]) & (rows["stratum"] == counts["_t"]))
    return rows.withColumn("taken", F.least("_all", "pool_n")).select("system", "stratum", "for_stratum", "quota", "lo", "hi", "taken", "pool_n")


def quota_sample(pool: DataFrame, key: list[str], quotas: list[tuple[str, int]], fallback: dict[str, str], seed: str) -> DataFrame:
    """Per system, each stratum's quota from its pool; what a pool lacks comes from the fallback's, after those that chose before.

    Adds ``for_stratum`` (whose quota the unit fills), ``rank`` in its pool, ``inclusion_prob`` (that quota over the
    pool, 1 at most, six places) and ``exact_prob`` (all that is taken from the pool over the pool; over a pool's units it sums
    to the number drawn). Only as many rows of a pool as all quotas together leave a task.
    """
    most = sum(n for _, n in quotas)
    shuffled = Window.partitionBy("system", "stratum").orderBy(draw(seed, "system", "stratum", *key), *key)
    ranked = pool.withColumn("rank", F.row_number().over(shuffled)).where(F.col("rank") <= most)
    parts = _segments(pool, quotas, fallback).withColumnsRenamed({"system": "_s", "stratum": "_t"})
    rows = ranked.join(parts, ranked["system"].eqNullSafe(parts["_s"]) & (ranked["stratum"] == parts["_t"]) & (ranked["rank"] > parts["lo"]) & (ranked["rank"] <= parts["hi"]))
    share = lambda c: F.col(c) / F.col("pool_n")
    return rows.withColumns({"inclusion_prob": F.round(F.least(F.lit(1.0), share("quota")), 6), "exact_prob": share("taken")}).drop("_s", "_t", "quota", "lo", "hi", "taken", "pool_n")


def practice_units(pool: DataFrame, picked: DataFrame, key: list[str], n: int, seed: str) -> DataFrame:
    """n units of the pool that were not picked, for training, with ``position`` from 0."""
    rest = pool.join(picked.select("system", *key), ["system", *key], "left_anti")
    order = [draw(f"{seed}|practice", "system", *key), *key]
    some = rest.orderBy(*order).limit(n)
    return some.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


def presentation(picked: DataFrame, key: list[str], repeats: float, seed: str) -> DataFrame:
    """The picked units in shuffled order, and ``repeats`` of them once more: first seen in the first half, repeated in the second.

    Adds ``base_unit`` (place among the units), ``is_repeat``, ``position`` and ``display_id``, which tells nothing of
    the unit. The windows take the sample, which quotas bound.
    """
    order = [draw(f"{seed}|order", "system", *key), *key]
    rows = picked.withColumns({"base_unit": F.row_number().over(Window.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    half = F.floor(F.col("_n") / 2)
    early = rows.where(F.col("base_unit") < half)
    chance = [draw(f"{seed}|repeat", "system", *key), "base_unit"]
    again = early.withColumn("_r", F.row_number().over(Window.orderBy(*chance))).where(F.col("_r") <= F.bround(F.col("_n") * repeats)).drop("_r")
    spot = F.conv(F.substring(draw(f"{seed}|spot", "system", *key), 1, 12), 16, 10).cast("long")
    again = again.withColumns({"is_repeat": F.lit(True), "_at": half + 1 + spot % (F.col("_n") - half)})
    both = rows.withColumns({"is_repeat": F.lit(False), "_at": F.col("base_unit").cast("long")}).unionByName(again)
    both = both.withColumn("position", F.row_number().over(Window.orderBy("_at", F.desc("is_repeat"), "base_unit")) - 1)
    return both.withColumn("display_id", F.substring(draw(seed, "position", "system", *key), 1, 10)).drop("_n", "_at")
