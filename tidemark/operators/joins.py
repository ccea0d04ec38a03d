"""As-of, range and overlap joins, and keyed edits.

Spark has no as-of join and turns a bare range predicate into a nested loop, so
these are windows over a union (as-of), equi joins on buckets of the range key
(overlap) or plain equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: str, inclusive: bool = True) -> DataFrame:
    """``payload`` of the latest ``right`` row at or before (or strictly before) each ``left`` row.

    Both sides have ``keys`` and ``at``. One shuffle on the keys, one sort, no
    pairs. Of right rows at one time the greatest payload counts. A key's rows
    share a task; ``salted_as_of`` divides long ones.
    """
    side = right.groupBy(*keys, at).agg(F.max(payload).alias("_p"))
    rows = left.withColumn("_side", F.lit(0 if not inclusive else 2)).unionByName(
        side.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    order = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(payload, F.last("_p", ignorenulls=True).over(order)).where("_side != 1").drop("_p", "_side")


def salted_as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: str, width: int) -> DataFrame:
    """``as_of`` with each key's time axis cut into parts of ``width`` (in units of ``at``), for hot keys.

    The last payload of each part is handed on to the following parts by a
    window over parts (few rows), and each part is then scanned by itself.
    """
    part = lambda df: df.withColumn("_part", F.floor(F.col(at) / width).cast("long"))
    r = part(right)
    ends = r.groupBy(*keys, "_part").agg(F.max(F.struct(at, payload)).alias("_e"))
    both = part(left).select(*keys, "_part").distinct().unionByName(ends.select(*keys, "_part")).distinct()
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = both.join(ends, [*keys, "_part"], "left").withColumn("_before", F.last("_e", ignorenulls=True).over(before))
    within = as_of(part(left), r, [*keys, "_part"], at, payload)
    return within.join(handed.select(*keys, "_part", "_before"), [*keys, "_part"], "left").withColumn(
        payload, F.coalesce(F.col(payload), F.col(f"_before.{payload}"))
    ).drop("_part", "_before")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of closed-inclusive spans [a_lo, a_hi], [b_lo, b_hi] that overlap within a key.

    Spans are dealt to buckets of ``bucket`` units; a pair is reported once, in
    the bucket in which the later of the two starts.
    """
    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        first, last = F.floor(F.col(lo) / bucket).cast("long"), F.floor(F.col(hi) / bucket).cast("long")
        return df.withColumn("_b", F.explode(F.sequence(first, last)))

    pairs = dealt(a, "a_lo", "a_hi").join(dealt(b, "b_lo", "b_hi"), [*keys, "_b"])
    starts = F.floor(F.greatest("a_lo", "b_lo") / bucket).cast("long")
    return pairs.where((F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("_b") == starts)).drop("_b")


def uncovered(spans: DataFrame, excluded: DataFrame, keys: list[str], lo: str, hi: str, bucket: int) -> DataFrame:
    """Spans that no single excluded span contains: an anti join on the bucket of the span's start."""
    holes = excluded.select(
        *keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
        F.explode(F.sequence(F.floor(F.col(lo) / bucket).cast("long"), F.floor(F.col(hi) / bucket).cast("long"))).alias("_b"),
    )
    rows = spans.withColumn("_b", F.floor(F.col(lo) / bucket).cast("long"))
    on = [rows[k] == holes[k] for k in keys] + [rows["_b"] == holes["_b"], F.col("_lo") <= rows[lo], F.col("_hi") >= rows[hi]]
    return rows.join(holes, on, "left_anti").drop("_b")


def deprecated_before(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """What events strictly before each chunk have deprecated: (story, chunk_id, item, reason).

    The first event that names an item decides when it goes, so events are
    reduced to one row an item before they meet the chunks.
    """
    gone = events.groupBy("story", "item").agg(F.min(F.struct("at", "event_id")).alias("e"))
    return chunks.join(gone, "story").where(F.col("e.at") < F.col("chunk_id")).select(
        "story", "chunk_id", "item", F.col("e.event_id").alias("reason")
    )


def slot_fill(slots: DataFrame, exact: DataFrame, keys: list[str], at: str, payload: str) -> DataFrame:
    """Every slot with its exact item, else the latest earlier one, else none: ``source`` says which."""
    best = exact.groupBy(*keys, at).agg(F.max(payload).alias("_exact"))
    rows = as_of(slots, exact, keys, at, payload).join(best, [*keys, at], "left")
    source = F.when(F.col("_exact").isNotNull(), "exact").when(F.col(payload).isNotNull(), "earlier").otherwise("none")
    return rows.withColumn("source", source).withColumn(payload, F.coalesce("_exact", payload)).drop("_exact")


def keyed_edits(items: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """Keep, reject, replace and add by key: a full outer join. An edit other than add of an unknown key raises."""
    e = edits.select(key, "action", F.col(value).alias("_new"))
    rows = items.withColumn("_have", F.lit(True)).join(e, key, "full_outer")
    unknown = F.col("_have").isNull() & (F.col("action") != "add")
    checked = F.when(unknown, F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("action"))
    rows = rows.withColumn("action", checked)
    kept = F.coalesce(F.col("action"), F.lit("keep")) != "reject"
    new = F.when(F.col("action").isin("replace", "add"), F.col("_new")).otherwise(F.col(value))
    return rows.where(kept).withColumn(value, new).select(*items.columns)


def control_pairs(presence: DataFrame, entities: DataFrame) -> DataFrame:
    """For each segment, pairs (x present, y of the same kind absent): a join on kind and an anti join.

    ``entities`` is a roster (a few entities a kind).
    """
    roster = entities.select("kind", F.col("eid").alias("absent"))
    pairs = presence.join(entities, "eid").join(roster, "kind").where(F.col("eid") != F.col("absent"))
    there = presence.select("story", "idx", F.col("eid").alias("absent"))
    return pairs.join(there, ["story", "idx", "absent"], "left_anti").select("story", "idx", "kind", "eid", "absent")


def first_by_rank(items: DataFrame, keys: list[str], path: str, rank: str) -> DataFrame:
    """The best-ranked row of each path."""
    own = Window.partitionBy(*keys, path).orderBy(rank)
    return items.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def prioritised(base: DataFrame, sides: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """``value`` from the first side that has it: left joins by falling priority."""
    out, found = base, []
    for n, (side, key) in enumerate(sides):
        out = out.join(side.select(key, F.col(value).alias(f"_v{n}")), key, "left")
        found.append(F.col(f"_v{n}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"_v{n}" for n in range(len(sides))])


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Share of equal answers among the keys that both passes have."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    same: Column = F.col("_a").eqNullSafe(F.col("_b")).cast("double")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 4).alias("agreement"))
