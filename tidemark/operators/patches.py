"""A reviewer's patch of a story's registry and its cascade through all tables that name its entities.

patch: story, place (its order), op, eid, value. ``merge`` folds entity eid into entity
value, ``drop`` removes eid, ``rename`` and ``describe`` give eid a name or a description,
``prompt`` gives chunk eid (its number as text) a prompt. All merges come before all drops,
these before the edits. A merge of unknown entities, of one with itself, or of one that is already
merged is left out, and so are edits of entities that are gone. A null story or id meets no patch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timeline import reappearance_tags


def _resolved(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each entity of one story's patch ends; chains of merges are followed from their ends."""
    gone: dict[str, str | None] = {}
    for op in ("merge", "drop"):
        for source, target in rows[rows["op"] == op].sort_values(["place", "eid"], kind="stable")[["eid", "value"]].itertuples(index=False, name=None):
            if source not in gone and (op == "drop" or (target not in gone and target != source)):
                gone[source] = target if op == "merge" else None
    last: dict[str, str | None] = {}
    for source, target in reversed(gone.items()):  # a target can go only after what was folded into it
        last[source] = last[target] if target in last else target
    story = rows["story"].iloc[:1].repeat(len(last)).reset_index(drop=True)
    return pd.DataFrame({"story": story, "eid": pd.Series(list(last), dtype=object), "new_id": pd.Series(list(last.values()), dtype=object)})


def id_map(patch: DataFrame, entities: DataFrame) -> DataFrame:
    """story, eid, new_id of all entities that a patch merges (new_id: where the last merge leaves them) or drops (null).

    Only the patch's own lines are gathered by story, never its tables.
    """
    known = entities.select("story", "eid").distinct()
    lines = patch.where(F.col("op").isin("merge", "drop")).select("story", "place", "op", "eid", "value")
    lines = lines.join(known, ["story", "eid"], "left_semi")
    targets = known.withColumnRenamed("eid", "value")
    merges = lines.where("op = 'merge'").join(targets, ["story", "value"], "left_semi")
    lines = merges.unionByName(lines.where("op = 'drop'"))
    kind = patch.schema["story"].dataType.simpleString()
    return lines.groupBy("story").applyInPandas(_resolved, f"story {kind}, eid string, new_id string")


def owned(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows under the entities they belong to after the patch, with ``old_id``; those of dropped entities go."""
    moved = ids.select("story", "eid", F.struct("new_id").alias("_to"))
    rows = rows.join(moved, ["story", "eid"], "left").withColumn("old_id", F.col("eid"))
    return rows.withColumn("eid", F.when(F.col("_to").isNull(), F.col("eid")).otherwise(F.col("_to.new_id"))).where("eid is not null").drop("_to")


def _edits(patch: DataFrame, op: str, to: str) -> DataFrame:
    """story, eid and the last value that the patch's lines of one kind give it."""
    return patch.where(F.col("op") == op).groupBy("story", "eid").agg(F.max_by("value", F.struct("place", "value")).alias(to))


def patched_entities(entities: DataFrame, ids: DataFrame, patch: DataFrame) -> DataFrame:
    """Entities (story, eid, kind, name, description, first_chunk) that stay; they appear first where any of those merged into them did."""
    firsts = owned(entities.select("story", "eid", "first_chunk"), ids).groupBy("story", "eid").agg(F.min("first_chunk").alias("first_chunk"))
    rows = entities.drop("first_chunk").join(ids, ["story", "eid"], "left_anti").join(firsts, ["story", "eid"])
    for op, field in (("rename", "name"), ("describe", "description")):
        rows = rows.join(_edits(patch, op, "_new"), ["story", "eid"], "left").withColumn(field, F.coalesce("_new", field)).drop("_new")
    return rows


def patched_representations(representations: DataFrame, ids: DataFrame) -> DataFrame:
    """Representations under their survivors; ids (and embedding keys) of the form entity@rest take the survivor's name."""
    rows = owned(representations, ids)
    own = F.col("old_id").isNotNull() & F.startswith("representation_id", F.concat("old_id", F.lit("@")))
    moved = own & (F.col("old_id") != F.col("eid"))
    new = F.concat("eid", F.substring("representation_id", F.length("old_id") + 1, F.length("representation_id")))
    rows = rows.withColumn("_id", F.when(moved, new).otherwise(F.col("representation_id")))
    if "embedding_key" in rows.columns:
        rows = rows.withColumn("embedding_key", F.when(moved, F.col("_id")).otherwise(F.col("embedding_key")))
    return rows.withColumn("representation_id", F.col("_id")).drop("_id", "old_id")


def patched_chunks(chunks: DataFrame, entities: DataFrame, ids: DataFrame, patch: DataFrame) -> DataFrame:
    """Chunks (story, chunk_id, present, prompt) with what follows from the patch.

    ``present`` is distinct and sorted, ``first_appearances`` are those whose patched entity appears first
    here, ``instructions`` say introduce for them and continuity for the rest, ``tags`` tell the kinds that
    return. ``entities`` are the patched ones; a present id without an entity stays and is never new. A chunk
    whose entities are all dropped stays, empty.
    """
    seen = owned(chunks.select("story", "chunk_id", F.explode("present").alias("eid")), ids).select("story", "chunk_id", "eid").distinct()
    seen = seen.join(entities.select("story", "eid", "kind", "first_chunk"), ["story", "eid"], "left")
    tags = reappearance_tags(seen.withColumn("idx", F.col("chunk_id"))).withColumnRenamed("idx", "chunk_id")
    new = F.coalesce(F.col("first_chunk") == F.col("chunk_id"), F.lit(False))
    facts = seen.groupBy("story", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("eid", new.alias("new")))).alias("_p"))
    rows = chunks.drop("present").join(facts, ["story", "chunk_id"], "left").join(tags, ["story", "chunk_id"], "left")
    none = F.array().cast(facts.schema["_p"].dataType)
    rows = rows.withColumns({"_p": F.coalesce("_p", none), "tags": F.coalesce("tags", F.lit("none"))})
    prompts = _edits(patch, "prompt", "_new").withColumn("chunk_id", F.expr(f"try_cast(eid as {chunks.schema['chunk_id'].dataType.simpleString()})")).drop("eid")
    return (
        rows.withColumns(
            {
                "present": F.col("_p.eid"),
                "first_appearances": F.transform(F.filter("_p", lambda x: x["new"]), lambda x: x["eid"]),
                "instructions": F.transform("_p", lambda x: F.struct(x["eid"].alias("eid"), F.when(x["new"], "introduce").otherwise("continuity").alias("requirement"))),
            }
        )
        .join(prompts, ["story", "chunk_id"], "left")
        .withColumn("prompt", F.coalesce("_new", "prompt"))
        .drop("_p", "_new")
    )


def disposition_faults(patch: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Merges and drops without the matching record (story, eid, action: merged or dropped), in stories that have any record.

    A patch with faults must not be applied.
    """
    needed = patch.where(F.col("op").isin("merge", "drop")).withColumn("needs", F.when(F.col("op") == "merge", "merged").otherwise("dropped"))
    strict = needed.join(dispositions.select("story").distinct(), "story", "left_semi")
    had = dispositions.select("story", "eid", F.col("action").alias("needs")).distinct()
    return strict.join(had, ["story", "eid", "needs"], "left_anti").select("story", "eid", "op", "needs")
