"""Timeline queries (ordered sequences, presence, spans) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import gap_bin, manifest_bin
from tidemark.operators import timeline as T

from .bindings import FACTS, GAPS, PRESENCE, STATE, TIMELINE, facts, presence, stateful, table, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TIMELINE}, {GAPS}
SELECT eid, CASE WHEN gap <= 0 THEN '0' WHEN gap <= 4 THEN '1-4' WHEN gap <= 29 THEN '5-29' WHEN gap >= 30 THEN '>=30' END AS gap_bin,
  count(*) AS n, CAST(sum(gap) AS BIGINT) AS gap_sum, count(DISTINCT story) AS n_stories
FROM gp GROUP BY 1, 2""")
def gap_timeline(spark, d):
    """Gaps since an entity was last seen, by bin."""
    g = T.gaps(timeline(spark, d)).withColumn("gap_bin", gap_bin(F.col("gap")))
    return g.groupBy("eid", "gap_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap_sum"), F.countDistinct("story").alias("n_stories")
    )


@query(f"""WITH {TIMELINE}, {GAPS}
SELECT CASE WHEN gap <= 4 THEN '1-4' WHEN gap <= 29 THEN '5-29' WHEN gap >= 30 THEN '>=30' END AS gap_bin, count(*) AS n,
  max(gap) AS longest FROM gp WHERE gap IS NOT NULL GROUP BY 1""")
def manifest_gap_histogram(spark, d):
    """Gap histogram of the manifest, where gap 0 falls in the lowest bin."""
    g = T.gaps(timeline(spark, d)).where("gap is not null")
    return g.groupBy(manifest_bin(F.col("gap")).alias("gap_bin")).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("longest"))


@query(f"""WITH {TIMELINE}, {GAPS}, st AS (SELECT *, {STATE} FROM gp),
ca AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY story, eid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM st)
SELECT story, idx, eid, gap, state, carried, CASE WHEN gap IS NULL THEN 'introduce'
  WHEN state IS NOT NULL AND carried IS NOT NULL AND state != carried THEN 'transform' WHEN gap = 0 THEN 'persist'
  WHEN gap >= 30 THEN 'recall_after_gap' ELSE 'recall' END AS op FROM ca""")
def memory_operations(spark, d):
    """Introduce, transform, persist, recall or recall after a gap, with the state carried forward."""
    rows = T.memory_ops(stateful(timeline(spark, d)))
    return rows.select("story", "idx", "eid", "gap", "state", "carried", "op")


@query(f"""WITH {TIMELINE}, rm AS (SELECT story, eid, idx AS at FROM tl WHERE value > 30)
SELECT t.story, t.idx, r.eid, max(r.at) AS removed_at, t.idx - max(r.at) AS since FROM tl t JOIN rm r
  ON t.story = r.story AND t.idx > r.at AND t.idx <= r.at + 4 GROUP BY t.story, t.idx, r.eid""")
def forbidden_window(spark, d):
    """Entities to be avoided in the segments after their removal."""
    t = timeline(spark, d)
    removals = t.where("value > 30").select("story", "eid", F.col("idx").alias("at"))
    return T.forbidden_after(removals, t.select("story", "idx"))


@query(f"""WITH {TIMELINE}, o AS (
  SELECT story, eid, idx AS lo, idx + CAST(floor(value) AS BIGINT) % 4 AS hi FROM tl),
m AS (SELECT *, max(hi) OVER (PARTITION BY story, eid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo - 1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY story, eid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT story, eid, min(lo) AS lo, max(hi) AS hi, count(*) AS n_spans FROM i GROUP BY story, eid, g""")
def merged_frame_spans(spark, d):
    """Closed-inclusive spans merged where they overlap or adjoin."""
    t = timeline(spark, d)
    spans = t.select("story", "eid", F.col("idx").alias("lo"), (F.col("idx") + F.floor("value").cast("long") % 4).alias("hi"))
    return T.islands(spans, ["story", "eid"], "lo", "hi", adjacent=1)


@query(f"""WITH {TIMELINE}, o AS (
  SELECT story, eid, sec AS lo, sec + 60 * CAST(floor(value) AS BIGINT) AS hi FROM tl),
m AS (SELECT *, max(hi) OVER (PARTITION BY story, eid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY story, eid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT story, eid, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY story, eid, g),
w AS (SELECT *, lead(lo) OVER (PARTITION BY story, eid ORDER BY lo) - hi AS gap FROM u)
SELECT story, eid, CAST(sum(hi - lo) AS BIGINT) AS covered, min(lo) AS first_at, max(hi) AS last_at, coalesce(max(gap), 0) AS max_gap, count(*) AS n_islands
FROM w GROUP BY story, eid""")
def entity_time_metadata(spark, d):
    """Screen time, first, last and longest absence of each entity."""
    t = timeline(spark, d)
    spans = t.select("story", "eid", F.col("sec").alias("lo"), (F.col("sec") + 60 * F.floor("value").cast("long")).alias("hi"))
    return T.span_metadata(spans, ["story", "eid"], "lo", "hi")


@query(f"""WITH {PRESENCE} SELECT story, idx, eid, min(idx) OVER (PARTITION BY story, eid) AS first_idx,
  idx = min(idx) OVER (PARTITION BY story, eid) AS is_first FROM pr""")
def first_appearances(spark, d):
    """The chunk in which each entity of a story is seen first."""
    return T.first_appearances(presence(spark, d).drop("kind"))


@query(f"""WITH {PRESENCE}, g AS (SELECT *, idx - lag(idx) OVER (PARTITION BY story, eid ORDER BY idx) - 1 AS gap FROM pr)
SELECT story, idx, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN gap >= 1 THEN 'return_' || kind END) FILTER (gap >= 1))), ','), 'none') AS tags
FROM g GROUP BY story, idx""")
def scenario_tags(spark, d):
    """Which kinds of entity return to a chunk after an absence."""
    return T.reappearance_tags(presence(spark, d))


@query(f"""WITH {PRESENCE}, g AS (SELECT *, idx - lag(idx) OVER (PARTITION BY story, eid ORDER BY idx) - 1 AS gap FROM pr),
m AS (SELECT *, gap IS NULL OR gap > 0 AS must FROM g),
c AS (SELECT *, count(*) FILTER (must) OVER (PARTITION BY story, eid) AS n_must, count(*) OVER (PARTITION BY story, eid) AS n_all,
  row_number() OVER (PARTITION BY story, eid, must ORDER BY idx) - 1 AS pos FROM m),
p AS (SELECT *, greatest(0, 8 - n_must) AS room, n_all - n_must AS n_fill FROM c),
k AS (SELECT * FROM p WHERE must OR n_fill <= room OR list_contains(list_transform(range(0, room), lambda i: CAST(round_even(i * (n_fill - 1) / greatest(room - 1, 1)::DOUBLE, 0) AS BIGINT)), pos)),
r AS (SELECT story, eid, idx, must, row_number() OVER (PARTITION BY story, eid ORDER BY idx) AS rank FROM k)
SELECT story, eid, idx, must, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""")
def coverage_selection(spark, d):
    """Chunks of each entity to be looked at: first, returns, and evenly spaced fills."""
    return T.coverage_selection(presence(spark, d), 8)


@query(f"""WITH {TIMELINE}, c AS (SELECT story, idx, CAST(floor(value) AS BIGINT) AS dur FROM tl),
r AS (SELECT story, idx, dur, CAST(sum(dur) OVER (PARTITION BY story ORDER BY idx) AS BIGINT) AS clock_end FROM c)
SELECT story, idx, dur, clock_end, clock_end - dur AS clock_start FROM r""")
def observe_clock(spark, d):
    """Running clock of a story's clips."""
    t = timeline(spark, d).select("story", "idx", F.floor("value").cast("long").alias("dur"))
    return T.running_clock(t, "dur")


@query(f"""WITH {TIMELINE}, b AS (SELECT story, min(idx) AS first_bad FROM tl WHERE value > 90 GROUP BY story)
SELECT t.story, t.idx, t.event_id FROM tl t LEFT JOIN b USING (story) WHERE first_bad IS NULL OR t.idx < first_bad""")
def closed_prefix(spark, d):
    """Segments before a story's first failed one."""
    t = timeline(spark, d).withColumn("ok", F.col("value") <= 90)
    return T.closed_prefix(t, "ok").select("story", "idx", "event_id")


@query(f"""WITH {TIMELINE}, s AS (SELECT story, idx, eid, CASE WHEN event_id % 4 != 0 THEN round(value, 1) END AS score FROM tl),
r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY score DESC NULLS LAST, idx) AS rank FROM s)
SELECT story, idx, eid, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def budget_cut(spark, d):
    """The five best scored items of each story; unscored ones come last, in their order."""
    t = timeline(spark, d).select("story", "idx", "eid", F.when(F.col("event_id") % 4 != 0, F.round("value", 1)).alias("score"))
    return T.rank_cut(t, ["story"], "score", "idx", 5)


@query(f"""WITH {TIMELINE}, c AS (SELECT story, idx, CAST(floor(value) AS BIGINT) + 1 AS dur, round(value, 1) AS score FROM tl),
s AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY story ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / CAST(sum(dur) OVER (PARTITION BY story) AS DOUBLE) AS share FROM c)
SELECT CASE WHEN share * 3 < 1 THEN 'early' WHEN share * 3 < 2 THEN 'mid' ELSE 'late' END AS third, count(*) AS n,
  round(sum(score * dur) / sum(dur), 4) AS weighted FROM s GROUP BY 1""")
def horizon_thirds(spark, d):
    """Duration-weighted score of the early, middle and late third of stories."""
    t = timeline(spark, d).select("story", "idx", (F.floor("value").cast("long") + 1).alias("dur"), F.round("value", 1).alias("score"))
    return T.horizon_thirds(t, "dur").groupBy("third").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("score") * F.col("dur")) / F.sum("dur"), 4).alias("weighted")
    )


@query(f"""WITH {TIMELINE}, b AS (SELECT DISTINCT story, sec // 86400 AS day FROM tl WHERE eid = 'purchase')
SELECT * FROM (SELECT story, day, lead(day) OVER (PARTITION BY story ORDER BY day) AS span_end FROM b) WHERE span_end IS NOT NULL""")
def shots_from_boundaries(spark, d):
    """Spans between consecutive boundaries."""
    b = timeline(spark, d).where("eid = 'purchase'").select("story", F.floor(F.col("sec") / 86400).alias("day"))
    return T.spans_from_boundaries(b, "day")


@query(f"""WITH RECURSIVE {TIMELINE}, b AS (SELECT DISTINCT story, sec FROM tl WHERE eid = 'click'),
k(story, sec) AS (SELECT story, min(sec) FROM b GROUP BY story
  UNION ALL SELECT k.story, (SELECT min(b.sec) FROM b WHERE b.story = k.story AND b.sec >= k.sec + 172800) FROM k WHERE k.sec IS NOT NULL)
SELECT story, sec FROM k WHERE sec IS NOT NULL""")
def spaced_boundaries(spark, d):
    """Boundaries that keep a least distance to the one kept before."""
    b = timeline(spark, d).where("eid = 'click'").select("story", "sec")
    return T.spaced_boundaries(b, "sec", 172800)


@query("""WITH s AS (SELECT conv_id AS story, turn, CAST(turn * 3 AS DOUBLE) AS lo, turn * 3 + (length(text) % 40) / 10.0 AS hi FROM conversations),
n AS (SELECT *, lo + least(0.5, (hi - lo) / 2) AS f FROM s),
x AS (SELECT story, turn, round(f + i, 3) AS t FROM n, LATERAL (SELECT unnest(range(0, CAST(floor(hi - 1e-6 - f) AS BIGINT) + 1)) AS i) WHERE hi > lo
  UNION ALL SELECT story, turn, round(lo, 3) FROM n WHERE hi <= lo)
SELECT story, turn, t FROM x""")
def frame_sample_times(spark, d):
    """One sample a second in every span, half a step in."""
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("story"), "turn", (F.col("turn") * 3).cast("double").alias("lo"),
        (F.col("turn") * 3 + (F.length("text") % 40) / 10.0).alias("hi"),
    )
    return T.sample_times(c, "lo", "hi", 1.0).select("story", "turn", "t")


@query(f"""WITH {TIMELINE}, c AS (SELECT story, row_number() OVER (PARTITION BY story ORDER BY sec, event_id) - 1 AS chunk_id, sec AS lo, sec + 7200 AS hi
  FROM tl WHERE eid = 'view'),
e AS (SELECT story, event_id, sec FROM tl WHERE eid = 'purchase'),
c2 AS (SELECT story, chunk_id, lo, least(hi, coalesce(lead(lo) OVER (PARTITION BY story ORDER BY lo, chunk_id), hi)) AS hi FROM c),
r AS (SELECT story, min(lo) AS first_lo, max(chunk_id) AS last_id FROM c2 GROUP BY story)
SELECT e.story, e.event_id, CAST(coalesce((SELECT max(c2.chunk_id) FROM c2 WHERE c2.story = e.story AND c2.lo <= e.sec AND e.sec < c2.hi),
  CASE WHEN r.first_lo IS NULL THEN NULL WHEN e.sec < r.first_lo THEN 0 ELSE r.last_id END) AS BIGINT) AS chunk_id
FROM e LEFT JOIN r USING (story)""")
def event_chunk_assignment(spark, d):
    """The chunk that holds each event; points outside are clamped."""
    from pyspark.sql import Window

    t = timeline(spark, d)
    order = Window.partitionBy("story").orderBy("sec", "event_id")
    own = Window.partitionBy("story").orderBy("lo", "chunk_id")
    chunks = t.where("eid = 'view'").select(
        "story", (F.row_number().over(order) - 1).cast("long").alias("chunk_id"), F.col("sec").alias("lo"), (F.col("sec") + 7200).alias("hi")
    )
    chunks = chunks.withColumn("hi", F.least("hi", F.coalesce(F.lead("lo").over(own), F.col("hi"))))
    events = t.where("eid = 'purchase'").select("story", "event_id", "sec")
    return T.event_chunks(events, chunks, "sec").select("story", "event_id", "chunk_id")


@query(f"""WITH {TIMELINE}, {GAPS}, {FACTS}
SELECT eid, count(*) FILTER (hit IS NOT NULL) AS all_n, count(*) FILTER (hit) AS all_hit,
  count(*) FILTER (hit IS NOT NULL AND op = 'introduce') AS introduce_n, count(*) FILTER (hit AND op = 'introduce') AS introduce_hit,
  count(*) FILTER (hit IS NOT NULL AND op = 'persist') AS persist_n, count(*) FILTER (hit AND op = 'persist') AS persist_hit,
  count(*) FILTER (hit IS NOT NULL AND op = 'recall') AS continuity_n, count(*) FILTER (hit AND op = 'recall') AS continuity_hit,
  count(*) FILTER (hit IS NOT NULL AND gap >= 30) AS long_gap_n, count(*) FILTER (hit AND gap >= 30) AS long_gap_hit,
  count(*) FILTER (hit IS NULL) AS abstained
FROM fx GROUP BY eid""")
def capability_counters(spark, d):
    """Counters of each capability over the judged cast."""
    from tidemark.operators.scoring import capability_tally

    return capability_tally(facts(spark, d), ["eid"])


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, length(text) AS n FROM conversations),
o AS (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM w),
f(conv_id, i, used, g) AS (SELECT conv_id, i, n, 0 FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, CASE WHEN f.used + 1 + o.n <= 900 THEN f.used + 1 + o.n ELSE o.n END, CASE WHEN f.used + 1 + o.n <= 900 THEN f.g ELSE f.g + 1 END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, CAST(g AS INT) AS group_no, CAST(count(*) AS INT) AS n_items FROM f GROUP BY conv_id, g""")
def phrase_groups(spark, d):
    """Consecutive turns packed greedily by a budget of characters."""
    return T.greedy_groups(table(spark, d, "conversations"), ["conv_id"], "turn", "text", 900)
