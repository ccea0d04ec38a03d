"""Streams drained to tables, with the SQL of their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import causal, loop

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT conv_id AS story, turn AS idx, coalesce(array_to_string(list_slice(list_reverse(list(turn) OVER w), 1, 3), ','), '') AS sources,
  count(turn) OVER w AS n_seen FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def causal_stream(spark, d):
    """Each turn answered from the story's state before it."""
    turns = causal.read_stream(spark, d, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("idx"))
    return causal.drained(causal.answers(turns, 3))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def event_windows(spark, d):
    """Hourly counts with a watermark of ten minutes; windows that it has not passed are not yet told."""
    events = causal.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return causal.drained(causal.windowed_counts(events, "10 minutes", "1 hour"))


class Faulty:
    """A realiser that fails by a rule of story and segment; ``shift`` moves the rule."""

    def __init__(self, shift: int):
        self.shift = shift

    def realise(self, story, idx, prompt, sources):
        if (story + self.shift) % 3 == 0 and (story // 3 + idx) % 4 != self.shift:
            raise RuntimeError("no clip")
        return f"clip {idx} of {len(prompt)}"


TURNS = """t AS (SELECT conv_id AS story, turn AS idx, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT *, story % 3 = 0 AND (story // 3 + idx) % 4 <> 0 AS bad, (story + 1) % 3 = 0 AND (story // 3 + idx) % 4 <> 1 AS bad2 FROM t),
w AS (SELECT *, CASE WHEN bad AND lag(bad) OVER o AND lag(bad, 2) OVER o THEN 1 ELSE 0 END AS third FROM f WINDOW o AS (PARTITION BY story ORDER BY idx)),
r1 AS (SELECT * FROM (SELECT *, coalesce(sum(third) OVER (PARTITION BY story ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) WHERE before = 0)"""


def turns(frame):
    return frame.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("story"), F.col("turn").alias("idx"), F.col("text").alias("prompt"))


@query(f"""WITH {TURNS} SELECT story, idx, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status,
  coalesce(array_to_string(list_slice(list_reverse(list(idx) FILTER (NOT bad) OVER (PARTITION BY story ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1, 2), ','), '') AS sources,
  CASE WHEN NOT bad THEN 'clip ' || idx || ' of ' || length(coalesce(text, '')) END AS result, CASE WHEN bad THEN 'RuntimeError: no clip' END AS error, false AS resumed FROM r1""")
def closed_loop(spark, d):
    """Turns realised one after the other; some fail, and three failures in a row end a story."""
    segments = turns(causal.read_stream(spark, d, "conversations"))
    return causal.drained(loop.closed_loop(segments, loop.Newest(2), Faulty(0)))


@query(f"""WITH {TURNS}, c AS (SELECT *, max(bad OR idx <> n - 1) OVER (PARTITION BY story ORDER BY idx) AS broken FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY idx) AS n FROM r1)),
b AS (SELECT f.story, f.idx, coalesce(NOT c.broken, false) AS resumed, f.bad2 AND NOT coalesce(NOT c.broken, false) AS bad FROM f LEFT JOIN c ON c.story = f.story AND c.idx = f.idx),
g AS (SELECT *, CASE WHEN bad AND lag(bad) OVER o AND lag(bad, 2) OVER o THEN 1 ELSE 0 END AS third FROM b WINDOW o AS (PARTITION BY story ORDER BY idx)),
r AS (SELECT *, coalesce(sum(third) OVER (PARTITION BY story ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS there FROM g)
SELECT story, count(*) AS total, count(*) FILTER (there AND NOT bad) AS ok, count(*) FILTER (there AND bad) AS failed, count(*) FILTER (there AND resumed) AS resumed, NOT bool_and(there) AS given_up FROM r GROUP BY story""")
def loop_manifest(spark, d):
    """A second run takes up the first one's closed prefixes, under another rule of failure; one row a story."""
    segments = turns(spark.read.parquet(f"{d}/conversations.parquet"))
    first = loop.closed_loop(segments, loop.Newest(2), Faulty(0))
    second = loop.closed_loop(loop.taken_up(segments, first), loop.Newest(2), Faulty(1))
    return loop.manifest(segments, second)
