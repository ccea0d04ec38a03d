"""Author sources made from the events: a segment each, every third with an event of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import source_rules
from tidemark.operators.timeline import memory_ops

from .bindings import STATE, TIMELINE, stateful, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SOURCE = f"""{TIMELINE}, pr AS (SELECT story, idx, eid, CASE WHEN event_id % 11 = 0 THEN 's1' WHEN event_id % 13 = 0 THEN 's7' END AS state FROM tl),
ev AS (SELECT story, idx, CASE event_id % 15 WHEN 0 THEN 'remove' WHEN 3 THEN 'explode' ELSE 'state_change' END AS type,
  CASE event_id % 7 WHEN 0 THEN 'ghost' WHEN 1 THEN 'view' ELSE eid END AS eid, 's' || CAST(event_id % 4 AS VARCHAR) AS state_to, event_id % 2 = 0 AS shown FROM tl WHERE event_id % 3 = 0),
rg AS (SELECT DISTINCT story, eid, CASE WHEN eid IN ('view', 'click') THEN ['s0', 's1'] END AS states FROM tl WHERE eid <> 'signup')"""


@query(f"""WITH {SOURCE}, go AS (SELECT story, eid, min(idx) AS gone FROM ev WHERE type = 'remove' GROUP BY ALL)
SELECT pr.story, idx, pr.eid, 'removed_reenters' AS code, CAST(gone AS VARCHAR) AS detail FROM pr JOIN go ON go.story = pr.story AND go.eid = pr.eid WHERE idx > gone
UNION ALL SELECT story, idx, eid, 'unknown_event', type FROM ev WHERE type = 'explode'
UNION ALL SELECT story, idx, eid, 'unknown_present', NULL FROM pr WHERE eid = 'signup'
UNION ALL SELECT story, idx, eid, 'unknown_past_state', state FROM pr WHERE state = 's7' AND eid IN ('view', 'click')
UNION ALL SELECT pr.story, pr.idx, pr.eid, 'unknown_state', state_to FROM pr JOIN ev ON ev.story = pr.story AND ev.idx = pr.idx AND ev.eid = pr.eid
  WHERE state IS NULL AND pr.eid IN ('view', 'click') AND state_to NOT IN ('s0', 's1') AND (type = 'state_change' OR type = 'remove' AND shown)
UNION ALL SELECT story, idx, eid, 'unknown_removed', NULL FROM ev WHERE type = 'remove' AND NOT EXISTS (FROM rg WHERE rg.story = ev.story AND rg.eid = ev.eid)
UNION ALL SELECT story, idx, eid, 'removed_unseen', NULL FROM ev WHERE type = 'remove' AND shown AND EXISTS (FROM rg WHERE rg.story = ev.story AND rg.eid = ev.eid)
  AND NOT EXISTS (FROM pr WHERE pr.story = ev.story AND pr.idx = ev.idx AND pr.eid = ev.eid)""")
def source_rule_faults(spark, d):
    """Where author sources break the rules of presence, removal and states."""
    t = timeline(spark, d)
    n = F.col("event_id")
    present = t.select("story", "idx", "eid", F.when(n % 11 == 0, "s1").when(n % 13 == 0, "s7").alias("state"))
    events = t.where(n % 3 == 0).select(
        "story", "idx", F.lit(0).alias("place"), F.when(n % 15 == 0, "remove").when(n % 15 == 3, "explode").otherwise("state_change").alias("type"),
        F.when(n % 7 == 0, "ghost").when(n % 7 == 1, "view").otherwise(F.col("eid")).alias("eid"), F.concat(F.lit("s"), n % 4).alias("to"), (n % 2 == 0).alias("shown"),
    )
    states = F.when(F.col("eid").isin("view", "click"), F.array(F.lit("s0"), F.lit("s1")))
    registry = t.where("eid <> 'signup'").select("story", "eid").distinct().withColumn("states", states)
    return source_rules.source_faults(present, events, registry)


@query(f"""WITH {TIMELINE}, s AS (SELECT *, {STATE} FROM tl),
o AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY story, eid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried, lag(idx) OVER (PARTITION BY story, eid ORDER BY idx) AS seen FROM s),
k AS (SELECT story, idx, eid, seen IS NOT NULL AND state <> carried AS changed, seen = idx - 1 AND NOT coalesce(state <> carried, FALSE) AS kept FROM o)
SELECT story, idx, eid, 'persist_without_transform' AS code, CAST(NULL AS VARCHAR) AS detail FROM k
WHERE kept AND NOT EXISTS (FROM k j WHERE j.story = k.story AND j.eid = k.eid AND j.changed AND j.idx <= k.idx)""")
def persist_faults(spark, d):
    """Appearances that persist though nothing of their entity has changed before."""
    return source_rules.persist_faults(memory_ops(stateful(timeline(spark, d))).select("story", "idx", "eid", "op"))
