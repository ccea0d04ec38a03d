"""Annotation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as VEC
from tidemark.operators import annotation as A
from tidemark.operators import scoring as S
from tidemark.operators import similarity as V

from .bindings import PRESENCE, STATE, TIMELINE, presence, stateful, table, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TIMELINE}, s AS (SELECT *, {STATE} FROM tl), c AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY story, eid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS state_b FROM s),
p AS (SELECT *, lag(idx) OVER w AS prev_idx, lag(state_b) OVER w AS state_a FROM c WINDOW w AS (PARTITION BY story, eid ORDER BY idx))
SELECT story, idx, eid, prev_idx, state_a, state_b, CASE WHEN idx - prev_idx - 1 = 0 THEN 'gap0' WHEN state_a != state_b AND idx - prev_idx - 1 >= 30 THEN 'transform_ge30' WHEN state_a != state_b THEN 'transform' ELSE 'main' END AS stratum
FROM p WHERE prev_idx IS NOT NULL""")
def identity_units(spark, d):
    """Units of re-appearance with their strata."""
    return A.identity_units(stateful(timeline(spark, d))).select("story", "idx", "eid", "prev_idx", "state_a", "state_b", "stratum")


@query(f"""WITH {TIMELINE}, r AS (SELECT story, idx, eid, 'ev_' || eid AS base, row_number() OVER (PARTITION BY story, eid ORDER BY idx) - 1 AS k FROM tl WHERE value > 40)
SELECT story, idx, CASE WHEN k = 0 THEN base ELSE base || '.' || k END AS event_id FROM r""")
def event_numbering(spark, d):
    """Event ids with a suffix for repeats."""
    t = timeline(spark, d).where("value > 40").select("story", "idx", "eid", F.concat(F.lit("ev_"), "eid").alias("base"))
    return A.numbered_events(t, ["story"], "base", ["idx"]).select("story", "idx", "event_id")


@query(f"""WITH {TIMELINE}, e AS (SELECT story, eid, event_id, idx AS at_idx FROM tl WHERE value > 60), i AS (SELECT story, eid, idx AS item FROM tl WHERE value < 10)
SELECT e.story, e.eid, e.event_id, count(DISTINCT i.item) AS n, min(i.item) AS first_item, max(i.item) AS last_item FROM e LEFT JOIN i ON i.story = e.story AND i.eid = e.eid AND i.item <= e.at_idx GROUP BY ALL""")
def event_deprecations(spark, d):
    """Items that an event makes obsolete."""
    t = timeline(spark, d)
    events = t.where("value > 60").select("story", "eid", "event_id", F.col("idx").alias("at"))
    items = t.where("value < 10").select("story", "eid", F.col("idx").alias("item"), F.col("idx").alias("made_at"))
    out = A.deprecated_items(events, items)
    return out.select(
        "story", "eid", "event_id", F.size("deprecates").cast("long").alias("n"), F.array_min("deprecates").alias("first_item"), F.array_max("deprecates").alias("last_item")
    )


@query(f"""WITH {PRESENCE}, m AS (SELECT * FROM (VALUES ('view', 'click'), ('error', NULL)) t(eid, new_id)),
r AS (SELECT DISTINCT story, idx, CASE WHEN m.eid IS NULL THEN pr.eid ELSE m.new_id END AS eid FROM pr LEFT JOIN m ON pr.eid = m.eid)
SELECT story, idx, eid FROM r WHERE eid IS NOT NULL""")
def registry_patch(spark, d):
    """Presence after a merge and a drop of entities."""
    m = spark.createDataFrame([("view", "click"), ("error", None)], "eid string, new_id string")
    return A.remapped(presence(spark, d).drop("kind"), m).select("story", "idx", "eid")


@query(f"""WITH {TIMELINE}, s AS (SELECT story, idx, CAST(floor(value * 100) AS BIGINT) AS sim FROM tl), c AS (SELECT story, idx AS candidate FROM tl WHERE idx % 12 = 6),
n AS (SELECT c.story, candidate, idx, sim FROM c JOIN s ON s.story = c.story AND idx BETWEEN candidate - 5 AND candidate + 5),
f AS (SELECT story, candidate, idx, greatest(0, coalesce(lag(sim) OVER w, 60000) - sim) + greatest(0, coalesce(lead(sim) OVER w, 60000) - sim) AS disruption FROM n WINDOW w AS (PARTITION BY story, candidate ORDER BY idx))
SELECT story, candidate, idx + 1 AS refined, disruption FROM f QUALIFY row_number() OVER (PARTITION BY story, candidate ORDER BY disruption DESC, idx) = 1""")
def boundary_refinement(spark, d):
    """Candidate boundaries moved to the sharpest break near them; similarities are hundredths of the value."""
    t = timeline(spark, d).select("story", "idx", F.floor(F.col("value") * 100).cast("long").alias("sim"))
    return A.refined_boundaries(t, t.where("idx % 12 = 6").select("story", F.col("idx").alias("candidate")), ["story"], "idx", "sim", 5, 60000)


@query(f"""WITH {TIMELINE}, k AS (SELECT story, idx AS t, value, row_number() OVER (PARTITION BY story ORDER BY value DESC, event_id % 7 DESC, idx) AS r FROM tl)
SELECT story, t, CAST(row_number() OVER (PARTITION BY story ORDER BY t) AS INT) AS place FROM k WHERE r <= 5""")
def keyframe_candidates(spark, d):
    """The sharpest frames, in time order."""
    t = timeline(spark, d).select("story", F.col("idx").alias("t"), F.col("value").alias("sharpness"), (F.col("event_id") % 7).alias("contrast"))
    return A.sharp_frames(t, ["story"], 5).select("story", "t", "place")


@query("""WITH RECURSIVE c AS (SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS item, l_orderkey AS chunk, l_linenumber % 2 AS frame, l_returnflag AS kind, l_suppkey % 4 AS path, l_partkey % 5 AS y, max(CAST(l_quantity AS INTEGER)) AS score FROM lineitem GROUP BY ALL),
e AS (SELECT a.item AS u, b.item AS v FROM c a JOIN c b ON a.chunk = b.chunk AND a.frame = b.frame AND a.kind = b.kind AND a.item <> b.item AND (a.path = b.path OR a.y = b.y)),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), g AS (SELECT u AS item, least(u, min(v)) AS conflict FROM r GROUP BY u),
w AS (SELECT c.item, conflict, count(*) OVER p AS n_claims, row_number() OVER o AS k, score - lead(score) OVER o AS lead FROM c JOIN g USING (item) WINDOW p AS (PARTITION BY conflict), o AS (PARTITION BY conflict ORDER BY score DESC, c.item))
SELECT item, conflict, n_claims, k = 1 AND lead >= 15 AS kept FROM w UNION ALL SELECT item, NULL, 1, true FROM c WHERE item NOT IN (SELECT item FROM g)""")
def conflict_gate(spark, d):
    """Crops that several entities claim, by shared path or box."""
    li = table(spark, d, "lineitem")
    item = F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey") % 10000
    y = F.col("l_partkey") % 5 * 100
    crops = li.groupBy(
        item.alias("item"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_linenumber") % 2).alias("frame"), F.col("l_returnflag").alias("kind"), (F.col("l_suppkey") % 4).alias("path"),
        F.array(y, F.lit(0).cast("long"), y + 100, F.lit(500).cast("long")).alias("box"),
    ).agg(F.max(F.col("l_quantity").cast("int")).alias("score"))
    return A.conflict_winners(crops, 0.95, 15).select("item", "conflict", "n_claims", "kept")


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS x, c_nationkey AS y FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_mktsegment END AS x, c_nationkey AS y FROM customer WHERE c_acctbal < 8000)
SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NOT NULL AS in_both, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN CAST(a.x IS NOT DISTINCT FROM b.x AS INT) + CAST(a.y IS NOT DISTINCT FROM b.y AS INT) ELSE 0 END AS n_equal,
  a.k IS NOT NULL AND b.k IS NOT NULL AND a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y AS all_equal FROM a FULL JOIN b ON a.k = b.k""")
def run_parity(spark, d):
    """Field by field comparison of two runs."""
    c = table(spark, d, "customer")
    a = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("x"), F.col("c_nationkey").alias("y"))
    b = c.where("c_acctbal < 8000").select(F.col("c_custkey").alias("k"), F.when(F.col("c_nationkey") >= 5, F.col("c_mktsegment")).alias("x"), F.col("c_nationkey").alias("y"))
    return A.parity(a, b, ["k"], ["x", "y"])


@query(f"""WITH {TIMELINE}, i AS (SELECT story, eid, event_id AS item, value AS quality, eid < 'error' AS is_first FROM tl),
r AS (SELECT *, row_number() OVER (PARTITION BY story, eid ORDER BY quality DESC, item) AS k FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY is_first DESC, eid, k) AS place FROM r WHERE k <= 3) SELECT story, eid, item, CAST(place AS INT) AS place FROM p WHERE place <= 12""")
def payload_caps(spark, d):
    """Items shown for review under two caps."""
    t = timeline(spark, d).select("story", "eid", F.col("event_id").alias("item"), F.col("value").alias("quality"), (F.col("eid") < "error").alias("is_first"))
    return A.capped_payload(t, ["story"], 3, 12).select("story", "eid", "item", "place")


@query("""WITH p AS (SELECT a.label, a.vec_id % 4 AS side_a, b.vec_id % 4 AS side_b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 4 < b.vec_id % 4) SELECT label, side_a, side_b, max(sim) AS best, count(*) AS n FROM p GROUP BY ALL""")
def unit_similarity(spark, d):
    """Best similarity of the frames of two sides of a unit."""
    e = table(spark, d, "embeddings").withColumn("side", F.col("vec_id") % 4)
    return V.best_between(e, ["label"], "side", "embedding", "vec_id")


@query("""SELECT l_orderkey AS segment, count(*) AS n_pairs, round(avg(abs(a.l_discount - b.l_discount)), 6) AS mean_similarity FROM lineitem a JOIN
  (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem) b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber GROUP BY 1""")
def reference_redundancy(spark, d):
    """Mean similarity over the pairs of a segment's references."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("item"), "l_discount")
    out = S.pair_redundancy(li, ["segment"], F.abs(F.col("l.l_discount") - F.col("r.l_discount")))
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("""SELECT label, vec_id, round((coalesce(a * 1.0, 0) + coalesce(b * 0.6, 0) + coalesce(c * 0.3, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 1.0 END + CASE WHEN b IS NULL THEN 0 ELSE 0.6 END + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END, 0), 6) AS fused
FROM (SELECT label, vec_id, CASE WHEN vec_id % 3 != 0 THEN embedding[1]::DOUBLE END AS a, CASE WHEN vec_id % 4 != 0 THEN embedding[2]::DOUBLE END AS b, CASE WHEN vec_id % 5 != 0 THEN embedding[3]::DOUBLE END AS c FROM embeddings)""")
def cue_fusion(spark, d):
    """Weighted mean over the cues that an item has."""
    e = table(spark, d, "embeddings")
    cue = lambda k, n: F.when(F.col("vec_id") % k != 0, F.get("embedding", F.lit(n)).cast("double"))
    return e.select("label", "vec_id", F.round(VEC.fused([cue(3, 0), cue(4, 1), cue(5, 2)], [1.0, 0.6, 0.3]), 6).alias("fused"))


@query("""SELECT p_partkey, CASE WHEN array_length(string_split(p_name, ' ')) > 0 AND string_split(p_name, ' ')[-1] IN ('widget', 'ring') AND p_type = 'ECONOMY' THEN 'prop' ELSE lower(p_type) END AS kind FROM part""")
def demoted_kinds(spark, d):
    """Locations whose head noun is an object become props."""
    p = table(spark, d, "part")
    head = F.element_at(F.split("p_name", " "), -1)
    kind = F.when(head.isin("widget", "ring") & (F.col("p_type") == "ECONOMY"), "prop").otherwise(F.lower("p_type"))
    return p.select("p_partkey", kind.alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity < 5 THEN 'too_small' END, CASE WHEN l_discount <= 0.01 THEN 'blurred' END, CASE WHEN l_tax < 0.01 AND l_discount < 0.02 THEN 'dark_flat' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM lineitem WHERE l_returnflag != 'N'""")
def crop_audit(spark, d):
    """Reasons against a crop; one kind is exempt."""
    li = table(spark, d, "lineitem").where("l_returnflag != 'N'")
    reasons = F.array_compact(F.array(F.when(F.col("l_quantity") < 5, "too_small"), F.when(F.col("l_discount") <= 0.01, "blurred"), F.when((F.col("l_tax") < 0.01) & (F.col("l_discount") < 0.02), "dark_flat")))
    return li.select("l_orderkey", "l_linenumber", F.array_join(reasons, ",").alias("reasons"))


@query(f"""WITH {TIMELINE}, r AS (SELECT idx, story, CAST(greatest(0, least(1000, round_even((idx % 640) * 1000.0 / 640, 0))) AS INT) AS x, CAST(round_even(CAST(greatest(0, least(1000, round_even((idx % 640) * 1000.0 / 640, 0))) AS INT) * 640 / 1000.0, 0) AS INT) AS back FROM tl)
SELECT story, idx, x, back FROM r""")
def box_grid(spark, d):
    """Pixel coordinates to the grid and back."""
    t = timeline(spark, d)
    px = (F.col("idx") % 640).cast("int")
    grid = VEC.pixels_to_grid(F.array(px, px, px, px), F.lit(640), F.lit(640))
    t = t.withColumn("g", grid)
    return t.select("story", "idx", F.get("g", F.lit(1)).alias("x"), F.get(VEC.grid_to_pixels(F.col("g"), F.lit(640), F.lit(640)), F.lit(0)).alias("back"))


@query("""WITH m AS (SELECT map {'color': CASE p_size % 3 WHEN 0 THEN 'Red' ELSE 'blue' END, 'size': CAST(p_size % 5 AS VARCHAR)} AS a, map {'color': CASE WHEN p_partkey % 2 = 0 THEN 'RED' ELSE 'Blue' END, 'size': CAST(p_partkey % 5 AS VARCHAR)} AS b, p_partkey FROM part)
SELECT p_partkey, (CAST(lower(a['color']) = lower(b['color']) AS INT) + CAST(a['size'] = b['size'] AS INT)) / 2.0 >= 0.5 AS compatible FROM m""")
def static_compatibility(spark, d):
    """Whether static attributes agree on half of their common keys."""
    p = table(spark, d, "part")
    a = F.create_map(F.lit("color"), F.when(F.col("p_size") % 3 == 0, "Red").otherwise("blue"), F.lit("size"), (F.col("p_size") % 5).cast("string"))
    b = F.create_map(F.lit("color"), F.when(F.col("p_partkey") % 2 == 0, "RED").otherwise("Blue"), F.lit("size"), (F.col("p_partkey") % 5).cast("string"))
    return p.select("p_partkey", V.compatible(a, b, 0.5).alias("compatible"))


@query("""SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text) - length(replace(text, ',', ''))) AS BIGINT) AS template_hits, CASE WHEN count(*) < 3 THEN 'short' WHEN count(*) < 6 THEN 'medium' ELSE 'long' END AS bucket FROM conversations GROUP BY 1 HAVING count(*) >= 2""")
def quality_audit(spark, d):
    """Sizes, template hits and buckets of each story."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.regexp_count("text", F.lit(","))).cast("long").alias("template_hits"))
    bucket = F.when(F.col("n_turns") < 3, "short").when(F.col("n_turns") < 6, "medium").otherwise("long")
    return c.where("n_turns >= 2").withColumn("bucket", bucket)


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS system FROM lineitem), m AS (SELECT DISTINCT n_regionkey AS movie FROM nation), have AS (SELECT DISTINCT l_suppkey AS system, n_regionkey AS movie FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_discount > 0.09)
SELECT system, movie FROM have WHERE system IN (SELECT system FROM s) AND movie IN (SELECT movie FROM m)""")
def score_tasks(spark, d):
    """Tasks whose selection exists: the product of systems and movies is never formed."""
    li, s, n = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    have = li.where("l_discount > 0.09").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    have = have.select(F.col("l_suppkey").alias("system"), F.col("n_regionkey").alias("movie")).distinct()
    return have.join(li.select(F.col("l_suppkey").alias("system")).distinct(), "system", "left_semi").join(n.select(F.col("n_regionkey").alias("movie")).distinct(), "movie", "left_semi")


@query("""WITH w AS (SELECT c_custkey, round(-ln((CAST(('0x' || substr(sha256('risk:' || CAST(c_custkey AS VARCHAR)), 1, 12)) AS BIGINT) + 1) / 281474976710656.0) / (0.5 + c_nationkey % 3), 9) AS priority FROM customer)
SELECT c_custkey, priority FROM w ORDER BY priority, c_custkey LIMIT 25""")
def risk_sample(spark, d):
    """Chunks drawn by risk without replacement."""
    c = table(spark, d, "customer").select("c_custkey", (F.lit(0.5) + F.col("c_nationkey") % 3).alias("w"))
    return A.weighted_order(c, "c_custkey", F.col("w"), "risk", 25).select("c_custkey", "priority")


@query("""WITH i AS (SELECT l_suppkey AS eid, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS item, max(l_extendedprice) AS quality FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY eid, kind ORDER BY quality DESC, item) AS k FROM i) SELECT eid, kind, item FROM r WHERE k <= CASE kind WHEN 'A' THEN 8 WHEN 'R' THEN 5 ELSE 12 END""")
def library_caps(spark, d):
    """Libraries pruned to a cap by kind."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("eid"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).agg(F.max("l_extendedprice").alias("quality"))
    cap = F.when(F.col("kind") == "A", 8).when(F.col("kind") == "R", 5).otherwise(12)
    k = F.row_number().over(Window.partitionBy("eid", "kind").orderBy(F.desc("quality"), "item"))
    return li.withColumn("k", k).where(F.col("k") <= cap).select("eid", "kind", "item")
