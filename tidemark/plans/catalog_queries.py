"""Catalog, queue and roster queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine
from tidemark.operators import catalog as C

from .bindings import PRESENCE, TIMELINE, presence, table, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT o_orderkey, o_custkey AS lo, o_custkey + o_orderkey % 40 AS hi FROM orders), n AS (SELECT *, hi - lo + 1 AS size, least(7, hi - lo + 1) AS cnt FROM s)
SELECT o_orderkey, lo + CAST(floor(i * (size - 1) / CAST(greatest(cnt - 1, 1) AS DOUBLE)) AS BIGINT) AS frame FROM n, LATERAL (SELECT unnest(range(0, cnt)) AS i)""")
def even_frame_indices(spark, d):
    """Frames sampled evenly from each span."""
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("hi"))
    return C.even_indices(s, "lo", "hi", 7).select("o_orderkey", "frame")


@query("""WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)
SELECT label, vec_id, CASE WHEN prev IS NULL THEN NULL ELSE round(list_dot_product(embedding::DOUBLE[], prev::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(prev::DOUBLE[], prev::DOUBLE[]))), 6) END AS sim FROM p""")
def location_continuation(spark, d):
    """Similarity of each location to the one just before it."""
    prev = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    e = table(spark, d, "embeddings").withColumn("prev", prev)
    return e.select("label", "vec_id", F.when(F.col("prev").isNotNull(), F.round(cosine(F.col("embedding"), F.col("prev")), 6)).alias("sim"))


@query(f"""WITH {TIMELINE}, {PRESENCE}, s AS (SELECT story, idx AS seg, CAST(floor(value) AS BIGINT) % 32 AS day, value, eid FROM tl), c AS (SELECT story, seg, eid FROM s WHERE value > 50),
f AS (SELECT story, seg, eid FROM c UNION SELECT s.story, s.seg, pr.eid FROM s JOIN pr ON pr.story = s.story AND pr.idx = s.day),
b AS (SELECT s.story, s.seg, e.eid FROM s JOIN (SELECT DISTINCT story, eid FROM pr) e USING (story) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.story = s.story AND f.seg = s.seg))
SELECT story, seg, count(*) AS n, min(eid) AS first_eid FROM (SELECT * FROM f UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def segment_roster(spark, d):
    """Entities that may be in a segment; never none."""
    t, p = timeline(spark, d), presence(spark, d)
    segs = t.select("story", F.col("idx").alias("seg"), (F.floor("value").cast("long") % 32).alias("day"))
    claimed = t.where("value > 50").select("story", F.col("idx").alias("seg"), "eid")
    out = C.roster(segs, claimed, p.select("story", F.col("idx").alias("day"), "eid"), p.select("story", "eid").distinct())
    return out.groupBy("story", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("first_eid"))


@query("""WITH r AS (SELECT l_suppkey AS eid, l_orderkey AS frame, l_orderkey * 10 + l_linenumber AS item, l_extendedprice AS score, l_partkey // 400 AS x, CAST(floor(l_quantity / 10) AS BIGINT) AS y FROM lineitem),
a AS (SELECT eid, x, y, count(DISTINCT frame) AS n_frames, max(score) AS score FROM r GROUP BY ALL HAVING count(DISTINCT frame) >= 3), b AS (SELECT eid, max(score) AS score FROM a GROUP BY eid)
SELECT eid, score FROM b""")
def consistent_detection(spark, d):
    """The best detection that several frames agree on."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("eid"), F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
        F.col("l_extendedprice").alias("score"), (F.col("l_partkey") / 40.0).alias("cx"), F.col("l_quantity").alias("cy"),
    )
    return C.consistent_detections(li, ["eid"], 3, 10).select("eid", "score")


@query("""WITH i AS (SELECT s_suppkey AS machine, s_nationkey AS role FROM supplier WHERE s_acctbal > 0), n AS (SELECT o_custkey % 150 AS machine, CAST(max(epoch(o_orderdate)) AS BIGINT) AS heartbeat FROM orders GROUP BY 1),
w AS (SELECT l_suppkey AS machine, count(*) FILTER (l_discount > 0.09) AS load FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS machine FROM supplier WHERE s_acctbal > 9000), m AS (SELECT max(heartbeat) AS now FROM n),
j AS (SELECT coalesce(i.machine, n.machine) AS machine, role, heartbeat FROM i FULL JOIN n ON i.machine = n.machine)
SELECT j.machine, role, load, CASE WHEN b.machine IS NOT NULL THEN 'on_break' WHEN heartbeat IS NULL THEN 'missing' WHEN now - heartbeat > 8000000 THEN 'stale' WHEN coalesce(load, 0) > 0 THEN 'busy' ELSE 'idle' END AS status
FROM j LEFT JOIN w ON w.machine = j.machine LEFT JOIN b ON b.machine = j.machine, m""")
def fleet_status(spark, d):
    """Machines with their load and status."""
    s, o, li = table(spark, d, "supplier"), table(spark, d, "orders"), table(spark, d, "lineitem")
    beats = o.groupBy((F.col("o_custkey") % 150).alias("machine")).agg(F.max(F.unix_timestamp("o_orderdate")).alias("heartbeat"))
    loads = li.groupBy(F.col("l_suppkey").alias("machine")).agg(F.count_if(F.col("l_discount") > 0.09).alias("load"))
    newest = beats.agg(F.max("heartbeat").alias("now"))
    beats = beats.join(F.broadcast(newest))
    intents = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("machine"), F.col("s_nationkey").alias("role"))
    breaks = s.where("s_acctbal > 9000").select(F.col("s_suppkey").alias("machine"))
    return C.fleet(intents, beats, loads, breaks, F.col("now"), 8000000).select("machine", "role", "load", "status")


@query("""WITH s AS (SELECT l_suppkey AS system, l_orderkey AS story, count(*) AS n_segments FROM lineitem GROUP BY ALL), r AS (SELECT o_orderkey AS story, CASE o_orderstatus WHEN 'F' THEN 'DONE' ELSE 'RUNNING' END AS state, CASE WHEN o_orderpriority = '5-LOW' THEN CAST(1 AS BIGINT) END AS own_done FROM orders WHERE o_totalprice > 50000)
SELECT system, count(*) AS n_runs, count(*) FILTER (state = 'DONE') AS n_done, count(*) FILTER (state IS NULL) AS n_waiting, CAST(sum(n_segments) AS BIGINT) AS segments,
  CAST(sum(CASE WHEN own_done IS NOT NULL THEN own_done WHEN state = 'DONE' THEN n_segments ELSE 0 END) AS BIGINT) AS segments_done FROM s LEFT JOIN r USING (story) GROUP BY system""")
def progress_summary(spark, d):
    """Progress of each system."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_totalprice > 50000")
    plan = li.groupBy(F.col("l_suppkey").alias("system"), F.col("l_orderkey").alias("story")).agg(F.count(F.lit(1)).alias("n_segments"))
    state = F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("RUNNING")
    runs = o.select(F.col("o_orderkey").alias("story"), state.alias("state"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit(1).cast("long")).alias("own_done"))
    results = plan.select("system", "story").join(runs, "story")
    return C.progress(plan, results)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def review_queue(spark, d):
    """The card to be looked at first of each key."""
    cards = table(spark, d, "orders")
    return C.best_per_key(cards, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH h AS (SELECT o_orderstatus AS stratum, sha256(o_orderkey || '|' || o_orderpriority) AS h FROM orders),
p AS (SELECT substr(h, 1, 2) AS p, sum(CAST('0x' || substr(h, 3, 12) AS BIGINT)) AS s FROM h GROUP BY 1), w AS (SELECT sha256(string_agg(p || ':' || s, ',' ORDER BY p || ':' || s)) AS digest FROM p)
SELECT stratum, count(*) AS n, any_value(digest) AS digest FROM h CROSS JOIN w GROUP BY stratum""")
def manifest_counters(spark, d):
    """Strata counts and a digest of all lines."""
    o = table(spark, d, "orders")
    return C.manifest(o, "o_orderstatus", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"))


@query("""WITH a AS (SELECT l_orderkey AS seg, list_distinct(list(l_returnflag)) AS m, CAST(l_linenumber % 2 AS INT) AS batch FROM lineitem GROUP BY 1, 3),
x AS (SELECT a.seg, a.m AS m0, b.m AS m1 FROM a JOIN a b ON a.seg = b.seg AND a.batch = 0 AND b.batch = 1) SELECT seg, array_to_string(list_sort(list_intersect(m0, m1)), ',') AS missing FROM x""")
def split_batch_missing(spark, d):
    """What all batches of a segment miss."""
    li = table(spark, d, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("seg"), (F.col("l_linenumber") % 2).alias("batch")).agg(F.collect_set("l_returnflag").alias("m"))
    sets = per.groupBy("seg").agg(F.collect_list("m").alias("ms")).where(F.size("ms") == 2)  # two batches a segment
    common = F.aggregate(F.slice("ms", 2, 1), F.get("ms", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return sets.select("seg", F.array_join(F.array_sort(common), ",").alias("missing"))


@query("""WITH s AS (SELECT o_custkey AS card, o_orderkey % 20 AS lo, o_orderkey % 20 + o_orderkey % 6 AS hi FROM orders), c AS (SELECT DISTINCT card, unnest(range(lo, hi + 1)) AS chunk FROM s)
SELECT card, count(*) AS priority FROM c GROUP BY card""")
def card_priority(spark, d):
    """How many chunks a card's findings touch."""
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("card"), (F.col("o_orderkey") % 20).alias("lo"), (F.col("o_orderkey") % 20 + F.col("o_orderkey") % 6).alias("hi"))
    touched = s.select("card", F.explode(F.sequence("lo", "hi")).alias("chunk")).distinct()
    return touched.groupBy("card").agg(F.count(F.lit(1)).alias("priority"))


@query("""WITH e AS (SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS drift, count(*) FILTER (vec_id % 9 = 0) AS n_flagged FROM embeddings GROUP BY label)
SELECT label, n, n_flagged, round(0.5 * n_flagged / n + 0.3 * (CASE WHEN n < 40 THEN 1 ELSE 0 END) + 0.2 * abs(drift), 4) AS suspicion FROM e""")
def suspicion_scores(spark, d):
    """Weighted signals of a suspicious entity."""
    e = table(spark, d, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 6).alias("drift"), F.count_if(F.col("vec_id") % 9 == 0).alias("n_flagged")
    )
    score = 0.5 * F.col("n_flagged") / F.col("n") + 0.3 * F.when(F.col("n") < 40, 1).otherwise(0) + 0.2 * F.abs("drift")
    return e.select("label", "n", "n_flagged", F.round(score, 4).alias("suspicion"))


@query("""SELECT page_id, regexp_extract(url, '/([a-z]{2})/[0-9]', 1) AS lang, CASE WHEN regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) = '' THEN NULL ELSE 'seg_' || lpad(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), 6, '0') END AS segment FROM pages""")
def path_helpers(spark, d):
    """Ids read from a path."""
    number = F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1)
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "/([a-z]{2})/[0-9]", 1).alias("lang"), F.when(number != "", F.concat(F.lit("seg_"), F.lpad(number, 6, "0"))).alias("segment")
    )


@query("""WITH t AS (SELECT event_id, CAST(epoch(ts) AS BIGINT) AS sec, epoch(max(ts) OVER ()) AS newest FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))
SELECT event_id, sec, CAST(floor(newest - sec) AS BIGINT) > 864000 AS stale FROM t""")
def staleness(spark, d):
    """Ages by timestamps that are written with a zone."""
    e = table(spark, d, "events").select("event_id", F.unix_timestamp(F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))).alias("sec"))
    newest = e.agg(F.max("sec").alias("newest"))
    return e.join(F.broadcast(newest)).select("event_id", "sec", (F.col("newest") - F.col("sec") > 864000).alias("stale"))
