"""Rules that an author's source must keep: removed entities stay away, states and names are known, what persists has changed.

present: story, idx, eid and a past ``state`` that the segment shows (nullable); events: story, idx,
place, type, eid, to, shown (null: true); registry: story, eid, states (null: any). Each rule is a join
by equality with earliest places or with names, so no story is walked in order and a long one is
split like any other rows. Faults are story, idx, eid, code and detail, one for each row at fault,
repeated rows each; rows without a story or id are unknown to the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE, REMOVE = "state_change", "remove"


def _fault(rows: DataFrame, code: str, detail: Column | None = None) -> DataFrame:
    return rows.select("story", "idx", "eid", F.lit(code).alias("code"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def changes(events: DataFrame) -> DataFrame:
    """story, idx, eid, to: the state that a segment's last change of an entity (if none, its last shown removal) gives it."""
    at = lambda kind: F.when(F.col("type") == kind, F.struct("place", "to", F.coalesce("shown", F.lit(True)).alias("shown")))
    rows = events.where(F.col("type").isin(STATE, REMOVE)).groupBy("story", "idx", "eid").agg(F.max(at(STATE)).alias("c"), F.max(at(REMOVE)).alias("r"))
    to = F.when(F.col("c").isNotNull(), F.col("c.to")).when(F.col("r.shown"), F.col("r.to"))
    return rows.select("story", "idx", "eid", to.alias("to"), F.col("r").isNotNull().alias("removed"), F.col("r.shown").alias("shown"))


def source_faults(present: DataFrame, events: DataFrame, registry: DataFrame) -> DataFrame:
    """All faults of presence and events.

    removed_reenters (detail: where it was first removed), unknown_event (the type), unknown_present, unknown_past_state and
    unknown_state (the state), unknown_removed, removed_unseen (a shown removal of what is not present).
    """
    here = ["story", "idx", "eid"]
    known = registry.select("story", "eid", "states")
    names = known.select("story", "eid").distinct()
    gone = events.where(F.col("type") == REMOVE).groupBy("story", "eid").agg(F.min("idx").alias("gone"))
    last = changes(events)
    cast = present.join(known, ["story", "eid"])
    outside = lambda c: F.col("states").isNotNull() & ~F.coalesce(F.array_contains("states", F.col(c)), F.lit(False)) & F.col(c).isNotNull()
    turned = cast.where("state is null and states is not null").join(last.select(*here, "to"), here)
    removed = last.where("removed")
    seen = removed.where("shown").join(names, ["story", "eid"], "left_semi")
    parts = [
        _fault(present.join(gone, ["story", "eid"]).where("idx > gone"), "removed_reenters", F.col("gone")),
        _fault(events.where(~F.coalesce(F.col("type").isin(STATE, REMOVE), F.lit(False))), "unknown_event", F.col("type")),
        _fault(present.join(names, ["story", "eid"], "left_anti"), "unknown_present"),
        _fault(cast.where(outside("state")), "unknown_past_state", F.col("state")),
        _fault(turned.where(outside("to")), "unknown_state", F.col("to")),
        _fault(removed.join(names, ["story", "eid"], "left_anti"), "unknown_removed"),
        _fault(seen.join(present.select(*here).distinct(), here, "left_anti"), "removed_unseen"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def persist_faults(cast: DataFrame) -> DataFrame:
    """Rows (story, idx, eid, op) that persist before any transform of their entity in the story."""
    first = cast.where("op = 'transform'").groupBy("story", "eid").agg(F.min("idx").alias("changed"))
    return _fault(cast.where("op = 'persist'").join(first, ["story", "eid"], "left").where("changed is null or changed > idx"), "persist_without_transform")
