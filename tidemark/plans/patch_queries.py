"""Registry patches: by their number, stories get merges in chains, drops, edits and lines that don't apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import patches

from .bindings import PRESENCE, TIMELINE, presence, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: story % 3, op, eid, value in order.
LINES = [
    (0, "merge", "click", "view"), (0, "merge", "view", "purchase"), (0, "merge", "error", "click"), (0, "drop", "signup", None),
    (0, "rename", "purchase", "Shop"), (0, "rename", "view", "Window"), (0, "rename", "purchase", "Market"),
    (1, "drop", "error", None), (1, "merge", "view", "error"), (1, "describe", "click", "a knock"),
    (2, "merge", "view", "nobody"), (2, "merge", "signup", "signup"), (2, "prompt", "3", "day four"),
]


def tables(spark, d):
    """(entities, patch, ids) of all stories."""
    seen = presence(spark, d)
    entities = seen.groupBy("story", "eid", "kind").agg(F.min("idx").alias("first_chunk")).withColumns({"name": F.initcap("eid"), "description": F.lit(None).cast("string")})
    lines = F.array(*[F.struct(F.lit(of).alias("of"), F.lit(k).alias("place"), F.lit(op).alias("op"), F.lit(eid).alias("eid"), F.lit(value).cast("string").alias("value")) for k, (of, op, eid, value) in enumerate(LINES)])
    patch = seen.select("story").distinct().select("story", F.explode(lines).alias("x")).where("x.of = story % 3").select("story", "x.place", "x.op", "x.eid", "x.value")
    return entities, patch, patches.id_map(patch, entities)


# The merges that apply, worked out by hand: a later one counts only where an earlier one didn't take its ends away.
MOVES = f"""{PRESENCE}, en AS (SELECT story, eid, any_value(kind) AS kind, min(idx) AS first_chunk FROM pr GROUP BY story, eid),
ha AS (SELECT story, bool_or(eid = 'view') AS v, bool_or(eid = 'click') AS c, bool_or(eid = 'purchase') AS p, bool_or(eid = 'error') AS e FROM en GROUP BY story),
mp AS (SELECT story, eid, kind, first_chunk, CASE
    WHEN story % 3 = 0 AND eid = 'click' AND v THEN CASE WHEN p THEN 'purchase' ELSE 'view' END
    WHEN story % 3 = 0 AND eid = 'view' AND p THEN 'purchase'
    WHEN story % 3 = 0 AND eid = 'error' AND c AND NOT v THEN 'click'
    WHEN story % 3 = 0 AND eid = 'signup' THEN NULL
    WHEN story % 3 = 1 AND eid = 'error' THEN NULL
    WHEN story % 3 = 1 AND eid = 'view' AND e THEN NULL ELSE eid END AS owner FROM en JOIN ha USING (story)),
st AS (SELECT story, owner AS eid, min(first_chunk) AS first_chunk FROM mp WHERE owner IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {MOVES} SELECT st.story, st.eid, mp.kind, st.first_chunk,
  CASE WHEN st.story % 3 = 0 AND st.eid = 'purchase' THEN 'Market' WHEN st.story % 3 = 0 AND st.eid = 'view' THEN 'Window' ELSE upper(st.eid[1]) || st.eid[2:] END AS name,
  CASE WHEN st.story % 3 = 1 AND st.eid = 'click' THEN 'a knock' END AS description FROM st JOIN mp ON mp.story = st.story AND mp.eid = st.eid""")
def patched_registry(spark, d):
    """Entities that stay after a patch, with edits and the earliest first appearance."""
    entities, patch, ids = tables(spark, d)
    return patches.patched_entities(entities, ids, patch).select("story", "eid", "kind", "first_chunk", "name", "description")


@query(f"""WITH {TIMELINE}, {MOVES} SELECT tl.story, owner AS eid, CASE WHEN event_id % 4 = 0 THEN 'crop-' || event_id ELSE owner || '@' || event_id END AS representation_id, tl.idx
FROM tl JOIN mp ON mp.story = tl.story AND mp.eid = tl.eid WHERE owner IS NOT NULL AND value > 60""")
def patched_representations(spark, d):
    """Representations under their survivors, ids re-keyed."""
    ids = tables(spark, d)[2]
    rid = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("crop-"), "event_id")).otherwise(F.concat("eid", F.lit("@"), "event_id"))
    reps = timeline(spark, d).where("value > 60").select("story", "eid", rid.alias("representation_id"), "idx")
    return patches.patched_representations(reps, ids).select("story", "eid", "representation_id", "idx")


@query(f"""WITH {MOVES}, se AS (SELECT DISTINCT pr.story, pr.idx, owner AS eid FROM pr JOIN mp ON mp.story = pr.story AND mp.eid = pr.eid WHERE owner IS NOT NULL),
g AS (SELECT se.*, en.kind, st.first_chunk = se.idx AS new, idx - lag(idx) OVER (PARTITION BY se.story, se.eid ORDER BY idx) - 1 AS gap
  FROM se JOIN st USING (story, eid) JOIN en USING (story, eid)),
f AS (SELECT story, idx, string_agg(eid, ',' ORDER BY eid) AS present, string_agg(eid, ',' ORDER BY eid) FILTER (new) AS first_appearances,
  string_agg(eid || ':' || CASE WHEN new THEN 'introduce' ELSE 'continuity' END, ',' ORDER BY eid) AS instructions,
  array_to_string(list_sort(list_distinct(list(CASE WHEN gap >= 1 THEN 'return_' || kind END))), ',') AS tags FROM g GROUP BY story, idx)
SELECT c.story, c.idx AS chunk_id, coalesce(present, '') AS present, coalesce(first_appearances, '') AS first_appearances, coalesce(instructions, '') AS instructions,
  CASE WHEN coalesce(tags, '') = '' THEN 'none' ELSE tags END AS tags, CASE WHEN c.story % 3 = 2 AND c.idx = 3 THEN 'day four' ELSE 'day' END AS prompt
FROM (SELECT DISTINCT story, idx FROM pr) c LEFT JOIN f USING (story, idx)""")
def patched_chunks(spark, d):
    """Chunks after a patch: who is present and new, what is asked of each, and which kinds return."""
    entities, patch, ids = tables(spark, d)
    chunks = presence(spark, d).groupBy("story", F.col("idx").alias("chunk_id")).agg(F.collect_list("eid").alias("present")).withColumn("prompt", F.lit("day"))
    rows = patches.patched_chunks(chunks, patches.patched_entities(entities, ids, patch), ids, patch)
    asked = F.transform("instructions", lambda x: F.concat(x["eid"], F.lit(":"), x["requirement"]))
    return rows.select("story", "chunk_id", F.array_join("present", ",").alias("present"), F.array_join("first_appearances", ",").alias("first_appearances"), F.array_join(asked, ",").alias("instructions"), "tags", "prompt")
