"""Samples for human studies: units are appearances after a gap, missed or (for control) not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import study

from .bindings import FACTS, GAPS, TIMELINE, facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

QUOTAS = [("miss_near", 8), ("miss_mid", 8), ("miss_long", 8), ("miss_temporal", 4), ("control", 8)]
FALLBACK = {"miss_temporal": "miss_mid", "miss_long": "miss_mid"}
SEED = "tide"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def units(spark, d):
    f = facts(spark, d).where("hit is not null and gap >= 1")
    miss = F.when(F.col("event_id") % 50 == 0, "miss_temporal").when(F.col("gap") >= 30, "miss_long").when(F.col("gap") >= 5, "miss_mid").otherwise("miss_near")
    return f.select(F.concat(F.lit("s"), F.col("story") % 3).alias("system"), F.when(F.col("hit"), "control").otherwise(miss).alias("stratum"), "event_id")


POOL = f"""{TIMELINE}, {GAPS}, {FACTS}, u AS (SELECT 's' || CAST(story % 3 AS VARCHAR) AS system, event_id,
  CASE WHEN hit THEN 'control' WHEN event_id % 50 = 0 THEN 'miss_temporal' WHEN gap >= 30 THEN 'miss_long' WHEN gap >= 5 THEN 'miss_mid' ELSE 'miss_near' END AS stratum FROM fx WHERE hit IS NOT NULL AND gap >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY system, stratum ORDER BY sha256('{SEED}|' || system || '|' || stratum || '|' || CAST(event_id AS VARCHAR)), event_id) AS rank, count(*) OVER (PARTITION BY system, stratum) AS pool_n FROM u),
q AS (SELECT * FROM (VALUES ('miss_near', 8, 0, NULL), ('miss_mid', 8, 1, NULL), ('miss_long', 8, 2, 'miss_mid'), ('miss_temporal', 4, 3, 'miss_mid'), ('control', 8, 4, NULL)) t(for_stratum, n, place, other)),
a AS (SELECT s.system, q.*, (SELECT count(*) FROM u WHERE u.system = s.system AND u.stratum = q.for_stratum) AS had FROM (SELECT DISTINCT system FROM u) s, q),
w AS (SELECT system, for_stratum AS stratum, for_stratum, n, place, n AS want FROM a UNION ALL SELECT system, other, for_stratum, n, place, n - had FROM a WHERE had < n AND other IS NOT NULL),
b AS (SELECT *, sum(want) OVER (PARTITION BY system, stratum ORDER BY place) AS hi, sum(want) OVER (PARTITION BY system, stratum) AS total FROM w),
pk AS (SELECT r.system, r.stratum, r.event_id, b.for_stratum, CAST(rank AS INT) AS rank, round(least(1.0, CAST(n AS DOUBLE) / pool_n), 6) AS inclusion_prob, CAST(least(total, pool_n) AS DOUBLE) / pool_n AS exact_prob
  FROM r JOIN b ON b.system = r.system AND b.stratum = r.stratum AND rank > hi - want AND rank <= hi)"""


@query(f"WITH {POOL} SELECT system, stratum, event_id, for_stratum, rank, inclusion_prob, exact_prob FROM pk")
def study_sample(spark, d):
    """Quotas of every system, short ones filled from the next stratum."""
    return study.quota_sample(units(spark, d), ["event_id"], QUOTAS, FALLBACK, SEED)


@query(f"""WITH {POOL}, o AS (SELECT system, event_id, for_stratum, row_number() OVER (ORDER BY sha256('{SEED}|order|' || system || '|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS base_unit, count(*) OVER () AS n FROM pk),
g AS (SELECT * FROM o WHERE base_unit < n // 2 QUALIFY row_number() OVER (ORDER BY sha256('{SEED}|repeat|' || system || '|' || CAST(event_id AS VARCHAR)), base_unit) <= round_even(n * 0.1, 0)),
m AS (SELECT *, FALSE AS is_repeat, base_unit AS spot FROM o
  UNION ALL SELECT *, TRUE, n // 2 + 1 + CAST('0x' || substr(sha256('{SEED}|spot|' || system || '|' || CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) % (n - n // 2) FROM g),
p AS (SELECT *, row_number() OVER (ORDER BY spot, is_repeat DESC, base_unit) - 1 AS position FROM m)
SELECT system, event_id, for_stratum, CAST(base_unit AS INT) AS base_unit, is_repeat, CAST(position AS INT) AS position,
  substr(sha256('{SEED}|' || CAST(position AS VARCHAR) || '|' || system || '|' || CAST(event_id AS VARCHAR)), 1, 10) AS display_id FROM p""")
def study_presentation(spark, d):
    """The order in which a study shows its units, a tenth of them twice."""
    picked = study_sample(spark, d)
    return study.presentation(picked, ["event_id"], 0.1, SEED).select("system", "event_id", "for_stratum", "base_unit", "is_repeat", "position", "display_id")


@query(f"""WITH {POOL} SELECT system, stratum, event_id, CAST(row_number() OVER (ORDER BY sha256('{SEED}|practice|' || system || '|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS INT) AS position
FROM u WHERE event_id NOT IN (SELECT event_id FROM pk) QUALIFY position < 5""")
def study_practice(spark, d):
    """Five units for practice that the study doesn't use."""
    return study.practice_units(units(spark, d), study_sample(spark, d), ["event_id"], 5, SEED)
