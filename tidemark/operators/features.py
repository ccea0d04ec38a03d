"""Features of clips: which vectors a modality compares, and how alike the two sides of a unit are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot

CLIP = ("cond", "story", "gt", "variant")


def modality_vectors(entities: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """cond, story, gt, variant, eid, modality, vec: what each modality compares.

    Crops and faces count where the entity's score reaches ``threshold``; vectors of a
    whole frame or place serve any entity, so their ``eid`` is null.
    """

    def of(rows: DataFrame, modality: str, column: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select(*CLIP, "eid", F.lit(modality).alias("modality"), F.col(column).alias("vec"))

    seen = entities.where(F.col("score") >= threshold)
    whole = frames.withColumn("eid", F.lit(None).cast("string"))
    parts = [of(seen, "dino_crop", "crop"), of(seen, "face", "face"), of(whole, "location_dino", "frame_vec"), of(whole, "location_megaloc", "place_vec")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unit_modalities(units: DataFrame, modalities: dict[str, list[str]]) -> DataFrame:
    """Each unit once for every modality that is meant for its ``kind``."""
    fits = [F.when(F.col("kind").isin(kinds), name) for name, kinds in modalities.items()]
    return units.withColumn("modality", F.explode(F.array_compact(F.array(*fits))))


def unit_similarities(units: DataFrame, vectors: DataFrame, modalities: dict[str, list[str]]) -> DataFrame:
    """unit, modality, det_a, det_b, sim of each unit (unit, kind, a and b: structs of a clip's key and an eid).

    ``sim`` is the largest inner product of a vector of one side with one of the other,
    null where a side has none. A unit gathers the frames of two clips, never more;
    a unit's name must not repeat.
    """
    asked = unit_modalities(units, modalities)
    sides = asked.select("unit", "modality", F.explode(F.array(F.struct(F.lit("a").alias("side"), "a.*"), F.struct(F.lit("b").alias("side"), "b.*"))).alias("s"))
    sides = sides.select("unit", "modality", "s.*").withColumnRenamed("eid", "asked_eid")
    found = sides.join(vectors, [*CLIP, "modality"]).where(F.col("eid").isNull() | (F.col("eid") == F.col("asked_eid")))
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("vec")))
    grouped = found.groupBy("unit", "modality").agg(side("a").alias("va"), side("b").alias("vb"))
    best = F.array_max(F.transform("va", lambda x: F.array_max(F.transform("vb", lambda y: dot(x, y)))))
    rows = asked.select("unit", "modality").join(grouped, ["unit", "modality"], "left")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return rows.select("unit", "modality", has("va").alias("det_a"), has("vb").alias("det_b"), best.alias("sim"))
