"""Rankers and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, iou
from tidemark.operators import retrieval as R
from tidemark.operators import similarity as V

from .bindings import TIMELINE, table, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOK = r"regexp_extract_all(lower(text), '[A-Za-z0-9一-鿿]+')"


@query(f"""WITH q AS (SELECT item_id AS query, unnest({TOK}) AS token FROM benchmark), a AS (SELECT query, token, count(*) AS qtf FROM q GROUP BY ALL),
w AS (SELECT doc_id AS item, {TOK} AS t FROM documents), sz AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM w),
tf AS (SELECT item, len, token, count(*) AS tf FROM (SELECT item, len(t) AS len, unnest(t) AS token FROM w) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query, item, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * qtf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 6) AS score
  FROM a JOIN tf USING (token) JOIN df USING (token) CROSS JOIN sz GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s WHERE score > 0)
SELECT query, item, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def bm25_search(spark, d):
    """Lexical top ten of the corpus for every benchmark text."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    c = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    return R.bm25(q, c, 10)


@query(f"""WITH w AS (SELECT conv_id AS story, turn AS idx, {TOK} AS t FROM conversations),
tf AS (SELECT story, idx, len, token, count(*) AS tf FROM (SELECT story, idx, len(t) AS len, unnest(t) AS token FROM w) GROUP BY ALL),
h AS (SELECT a.story, a.idx AS q_idx, count(*) AS n_docs, avg(len(b.t)) AS avg_len FROM w a JOIN w b ON a.story = b.story AND b.idx < a.idx GROUP BY ALL),
df AS (SELECT a.story, a.idx AS q_idx, a.token, a.tf AS qtf, count(*) AS df FROM tf a JOIN tf b ON a.story = b.story AND a.token = b.token AND b.idx < a.idx GROUP BY ALL),
s AS (SELECT df.story, df.q_idx, tf.idx, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * qtf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 6) AS score
  FROM df JOIN tf ON tf.story = df.story AND tf.token = df.token AND tf.idx < df.q_idx JOIN h ON h.story = df.story AND h.q_idx = df.q_idx GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY story, q_idx ORDER BY score DESC, idx) AS rank FROM s WHERE score > 0)
SELECT story, q_idx, idx, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def causal_bm25(spark, d):
    """Each turn's best earlier turns, with statistics of its own history only."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("idx"), "text")
    return R.causal_bm25(c, 3)


@query("""WITH q AS (SELECT vec_id AS query, label, embedding FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS item, label, embedding FROM embeddings),
s AS (SELECT query, item, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM q JOIN c USING (label) WHERE item < query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) SELECT query, item, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def causal_dense(spark, d):
    """Best earlier vectors of a query's story by plain product."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label", F.col("embedding").alias("q_vec"), (F.col("vec_id") - 1).alias("as_of"))
    c = e.select(F.col("vec_id").alias("item"), "label", F.col("embedding").alias("vec"), F.col("vec_id").alias("ends"))
    return R.dense(q, c, ["label"], 5)


@query(f"""WITH {TIMELINE} SELECT a.story, a.idx AS q_idx, CAST(r AS INT) AS rank, a.idx - r AS idx, round(1.0 / r, 6) AS score FROM tl a, range(1, 5) t(r) WHERE a.idx - r >= 0""")
def recency(spark, d):
    """The newest earlier segments of each segment."""
    return R.recency(timeline(spark, d), 4)


@query("""WITH r AS (SELECT conv_id AS story, turn, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('seed:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), turn) AS rank FROM conversations)
SELECT story, turn, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def random_retriever(spark, d):
    """Turns of a story in the order of a keyed hash."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("story"), "turn")
    return R.random_order(c, ["story"], "turn", 2, "seed")


@query("""WITH a AS (SELECT l_suppkey AS q, l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS INT) AS rank FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey AS q, l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS INT) AS rank FROM lineitem GROUP BY 1, 2),
u AS (SELECT q, item, rank, 0 AS l FROM a WHERE rank <= 30 UNION ALL SELECT q, item, rank, 1 FROM b WHERE rank <= 30),
s AS (SELECT q, item, round(sum(1.0 / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS met FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, met, item) AS rank FROM s) SELECT q, item, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def rank_fusion(spark, d):
    """Reciprocal rank fusion of two rankings."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("item")).agg(
        F.max("l_extendedprice").alias("a"), F.sum("l_quantity").alias("b")
    )
    return R.fuse([R.top(li, ["q"], "a", "item", 30), R.top(li, ["q"], "b", "item", 30)], ["q"], "item", 10)


@query("""WITH s AS (SELECT l_suppkey AS q, l_orderkey * 10 + l_linenumber AS seg, l_discount AS sc FROM lineitem),
r AS (SELECT q, seg, max(sc) AS score FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seg) AS rank FROM r),
f AS (SELECT q, rank, score, seg, unnest(range(0, 3)) AS fr FROM k WHERE rank <= 4),
p AS (SELECT q, CAST(rank AS INT) AS rank, CAST(fr AS INT) AS frame_rank, CAST(seg % 100 + fr AS BIGINT) AS seconds, round(score - 0.000001 * (rank + fr), 9) AS frame_score FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY frame_score DESC, rank, frame_rank) AS place FROM p) SELECT q, rank, frame_rank, seconds, frame_score, CAST(place AS INT) AS place FROM o WHERE place <= 6""")
def segment_frames(spark, d):
    """Best segments opened into frames and rescored by rank."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg")).agg(F.max("l_discount").alias("score"))
    segs = R.top(li, ["q"], "score", "seg", 4)
    frames = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("seg") % 100 + i)
    return R.open_segments(segs.select("q", "seg", "rank", "score"), ["q", "seg"], frames, 10**6).transform(
        lambda x: _best_frames(x)
    )


def _shots(spark, d):
    """queries, segments and frames: ten vectors in a row are a segment, which its sixth stands for; queries see earlier ones."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.floor(F.col("vec_id") / 10).alias("seg"), F.col("embedding").alias("vec"))
    queries = e.where("item % 40 = 0").select(F.col("item").alias("query"), F.col("vec").alias("q_vec"), F.col("seg").alias("as_of"), F.pmod("seg", F.lit(4)).alias("reel"))
    segs = e.where("item % 10 = 5").select(F.col("seg").alias("item"), "vec", (F.col("seg") + 1).alias("ends"), F.pmod("seg", F.lit(4)).alias("reel"))
    hits = R.dense(queries, segs, ["reel"], 4).withColumnRenamed("item", "seg")
    return queries.select("query", "q_vec"), hits, e


SHOTS = """fr AS (SELECT vec_id AS item, vec_id // 10 AS seg, embedding::DOUBLE[] AS v FROM embeddings), qs AS (SELECT item AS query, seg AS as_of, v FROM fr WHERE item % 40 = 0),
sg AS (SELECT query, s.seg, round(list_dot_product(q.v, s.v), 6) AS score FROM qs q JOIN fr s ON s.item % 10 = 5 AND s.seg % 4 = q.as_of % 4 AND s.seg + 1 <= q.as_of),
ht AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seg) AS rank FROM sg QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, seg) <= 4)"""


@query(f"""WITH RECURSIVE {SHOTS}, u AS (SELECT seg, item, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM fr),
c AS (SELECT seg, list(m ORDER BY pos) AS c FROM (SELECT seg, pos, avg(x) AS m FROM (SELECT seg, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u) GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT seg, item, v FROM u JOIN c USING (seg) QUALIFY row_number() OVER (PARTITION BY seg ORDER BY round(list_cosine_similarity(v, c), 9) DESC, item) = 1),
g AS (SELECT f.seg, f.item, list({{'item': u.item, 'v': u.v, 'far': CASE WHEN u.item = f.item THEN -1.0 ELSE 1 - list_dot_product(u.v, f.v) END}} ORDER BY u.item) AS items FROM f JOIN u ON u.seg = f.seg GROUP BY 1, 2),
st AS (SELECT seg, item, 0 :: BIGINT AS pick, items FROM g
  UNION ALL SELECT seg, nx.item, pick + 1, list_transform(items, lambda x: {{'item': x.item, 'v': x.v, 'far': CASE WHEN x.item = nx.item OR x.far < 0 THEN -1.0 ELSE least(x.far, 1 - list_dot_product(x.v, nx.v)) END}})
  FROM (SELECT *, list_filter(items, lambda x: round(x.far, 9) = list_max(list_transform(items, lambda y: round(y.far, 9))))[1] AS nx FROM st WHERE pick < 2) WHERE nx.far >= 0),
o AS (SELECT query, st.item, round(score - 0.000001 * (rank + pick + 1), 9) AS score, rank, pick FROM ht JOIN st USING (seg))
SELECT query, item, score, CAST(row_number() OVER w AS INTEGER) AS place FROM o WINDOW w AS (PARTITION BY query ORDER BY score DESC, rank, pick) QUALIFY row_number() OVER w <= 6""")
def segment_keyframes(spark, d):
    """Best segments opened into their farthest-point key frames."""
    from tidemark.operators import kernels as K

    _, hits, frames = _shots(spark, d)
    keys = K.farthest_points(frames, ["seg"], 3).select("seg", "item", "pick")
    return R.keyframe_hits(hits.select("query", "seg", "rank", "score"), keys, ["query"], 6)


@query(f"""WITH {SHOTS}, o AS (SELECT h.query, f.item, rank AS seg_rank, round(list_dot_product(q.v, f.v), 6) AS own FROM ht h JOIN fr f USING (seg) JOIN qs q USING (query)),
l AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY seg_rank, item) AS rank, 0 AS l FROM o
  UNION ALL SELECT query, item, row_number() OVER w, 1 FROM o WINDOW w AS (PARTITION BY query ORDER BY own DESC, seg_rank, item) QUALIFY row_number() OVER w <= 24),
s AS (SELECT query, item, round(sum(1.0 / (60 + rank)), 9) AS score, min(l * 1000000 + rank) AS met FROM l GROUP BY ALL)
SELECT query, item, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, met, item) QUALIFY row_number() OVER w <= 6""")
def segment_frame_rerank(spark, d):
    """Frames of the best segments, by their segment and by themselves, fused."""
    queries, hits, frames = _shots(spark, d)
    return R.coarse_to_fine(queries, hits, frames, 6)


def _best_frames(frames):
    from pyspark.sql import Window

    order = Window.partitionBy("q").orderBy(F.desc("frame_score"), "rank", "frame_rank")
    return frames.drop("place").withColumn("place", F.row_number().over(order)).where("place <= 6").select(
        "q", "rank", "frame_rank", "seconds", "frame_score", "place"
    )


@query(f"""WITH {TIMELINE}, p AS (SELECT story, idx, [idx - CAST(floor(value) AS BIGINT) % 7 - 1, idx - CAST(floor(value) AS BIGINT) % 3 - 1, idx - 1] AS raw FROM tl),
a AS (SELECT story, idx, list_filter(raw, lambda x: x >= 0) AS plan FROM p), k AS (SELECT *, CASE WHEN len(plan) = 0 THEN [] WHEN len(plan) = 1 OR plan[1] = plan[2] THEN [plan[1]] ELSE [plan[1], plan[2]] END AS kept FROM a)
SELECT story, idx, array_to_string(CASE WHEN len(kept) < 2 AND idx > 0 AND NOT list_contains(kept, idx - 1) THEN list_append(kept, idx - 1) ELSE kept END, ',') AS sources FROM k""")
def last_seen_plan(spark, d):
    """Planned shots without repeats, with the shot before as a filler."""
    whole = F.floor("value")
    raw = F.array(F.col("idx") - whole % 7 - 1, F.col("idx") - whole % 3 - 1, F.col("idx") - 1)
    t = timeline(spark, d).select("story", "idx", F.filter(raw, lambda x: x >= 0).alias("plan"))
    return R.planned_sources(t, "plan", 2).select("story", "idx", F.array_join("sources", ",").alias("sources"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""SELECT a.label, a.vec_id AS "left", b.vec_id AS "right", round({COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({COS}, 6) >= 0.3""")
def similar_pairs(spark, d):
    """Pairs of one label whose cosine passes a threshold."""
    e = table(spark, d, "embeddings")
    return V.pairs_within(e, ["label"], "vec_id", "embedding", 0.3)


@query(f"""WITH p AS (SELECT a.label, round({COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT e.label, e.n, d AS dispersion FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) e LEFT JOIN (SELECT label, min(sim) AS d FROM p GROUP BY 1) USING (label)""")
def dispersion(spark, d):
    """Least pairwise cosine of each entity."""
    e = table(spark, d, "embeddings")
    return V.dispersion(e, ["label"], "vec_id", "embedding")


CENTRES = """ps AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), ce AS (SELECT label, list(x ORDER BY i) AS vec FROM ps GROUP BY label)"""
CCOS = "list_dot_product(e.embedding::DOUBLE[], c.vec) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(c.vec, c.vec)))"


@query(f"""WITH {CENTRES}, s AS (SELECT e.vec_id AS item, e.label, c.label AS proto, round({CCOS}, 6) AS sim FROM embeddings e JOIN ce c ON e.label % 3 = c.label % 3),
b AS (SELECT item, label, proto, sim, row_number() OVER (PARTITION BY item ORDER BY sim DESC, proto) AS k FROM s), o AS (SELECT item, sim AS own FROM s WHERE proto = label)
SELECT b.item, b.label, proto AS best, sim AS best_sim, own AS own_sim, proto != label AND sim - own > 0.02 AS flagged FROM b JOIN o USING (item) WHERE k = 1""")
def mislabel_audit(spark, d):
    """Nearest prototype of the item's kind; another's clear lead flags the label."""
    e = table(spark, d, "embeddings")
    c = V.centroids(e.select("label", F.col("embedding").alias("vec")), ["label"]).select(F.col("label").alias("proto"), (F.col("label") % 3).alias("kind"), "vec")
    items = e.select(F.col("vec_id").alias("item"), "label", (F.col("label") % 3).alias("kind"), F.col("embedding").alias("vec"))
    return V.nearest_prototype(items, c, ["kind"], 0.02)


@query(f"""WITH {CENTRES}, s AS (SELECT e.vec_id AS item, c.label AS candidate, round({CCOS}, 6) AS sim FROM embeddings e CROSS JOIN ce c),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, candidate) AS k FROM s),
t AS (SELECT item, max(candidate) FILTER (k = 1) AS candidate, max(sim) FILTER (k = 1) AS sim, max(sim) FILTER (k = 2) AS second FROM r WHERE k <= 2 GROUP BY item)
SELECT item, candidate, sim, CASE WHEN sim < 0.28 THEN 'below_floor' WHEN second IS NULL THEN 'only_candidate' WHEN sim - second < 0.06 THEN 'ambiguous' ELSE 'assigned' END AS outcome FROM t""")
def closed_set_assignment(spark, d):
    """Assignment to a roster with a floor and a margin; the roster is ten prototypes."""
    e = table(spark, d, "embeddings")
    c = V.centroids(e.select("label", F.col("embedding").alias("vec")), ["label"]).select(F.col("label").alias("candidate"), F.col("vec").alias("c_vec"))
    items = e.select(F.col("vec_id").alias("item"), "embedding")
    scores = V.candidate_scores(items, c)
    return V.closed_set(scores, 0.28, 0.06).select("item", "candidate", "sim", "outcome")


@query(f"""WITH {CENTRES}, s AS (SELECT e.label, round({CCOS}, 6) AS sim FROM embeddings e JOIN ce c USING (label)) SELECT label, min(sim) AS least, round(avg(sim), 4) AS mean FROM s GROUP BY label""")
def cluster_cohesion(spark, d):
    """Least and mean similarity of a cluster's members to its centroid."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    c = V.centroids(e, ["label"]).withColumnRenamed("vec", "c_vec")
    s = e.join(c, "label").select("label", F.round(cosine(F.col("vec"), F.col("c_vec")), 6).alias("sim"))
    return s.groupBy("label").agg(F.min("sim").alias("least"), F.round(F.avg("sim"), 4).alias("mean"))


@query(f"""WITH p AS (SELECT a.vec_id, round({COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id < a.vec_id),
s AS (SELECT vec_id, max(sim) AS sim FROM p GROUP BY 1) SELECT e.vec_id, coalesce(s.sim, 0) AS sim, coalesce(s.sim, 0) < 0.25 AS flagged FROM embeddings e LEFT JOIN s USING (vec_id)""")
def prompt_completeness(spark, d):
    """Items without a similar enough earlier one of their label are flagged."""
    e = table(spark, d, "embeddings")
    pairs = V.nearest_earlier(e, ["label"], "vec_id", "embedding")
    out = e.select("vec_id").join(pairs, "vec_id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return out.select("vec_id", "sim", (F.col("sim") < 0.25).alias("flagged"))


BOX = "[l_partkey % 500, l_suppkey % 500, l_partkey % 500 + 100 + CAST(l_quantity AS BIGINT), l_suppkey % 500 + 200]"


@query(f"""WITH b AS (SELECT l_orderkey AS chunk, l_linenumber AS item, {BOX} AS box FROM lineitem),
p AS (SELECT a.chunk, a.item AS "left", b.item AS "right", greatest(0, least(a.box[3], b.box[3]) - greatest(a.box[1], b.box[1])) * greatest(0, least(a.box[4], b.box[4]) - greatest(a.box[2], b.box[2])) AS inter,
  (a.box[3] - a.box[1]) * (a.box[4] - a.box[2]) AS aa, (b.box[3] - b.box[1]) * (b.box[4] - b.box[2]) AS ab FROM b a JOIN b ON a.chunk = b.chunk AND a.item < b.item)
SELECT chunk, "left", "right", round(inter / CAST(aa + ab - inter AS DOUBLE), 6) AS iou FROM p WHERE inter > 0 AND inter / CAST(aa + ab - inter AS DOUBLE) >= 0.2""")
def box_conflicts(spark, d):
    """Boxes of one chunk that overlap by a threshold."""
    b = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("item"),
        F.array(F.col("l_partkey") % 500, F.col("l_suppkey") % 500, F.col("l_partkey") % 500 + 100 + F.col("l_quantity").cast("long"), F.col("l_suppkey") % 500 + 200).alias("box"),
    )
    r = b.select("chunk", F.col("item").alias("right"), F.col("box").alias("r_box"))
    pairs = b.withColumnsRenamed({"item": "left"}).join(r, "chunk").where(F.col("left") < F.col("right"))
    return pairs.select("chunk", "left", "right", iou(F.col("box"), F.col("r_box")).alias("raw")).where("raw >= 0.2").select("chunk", "left", "right", F.round("raw", 6).alias("iou"))


@query("""WITH RECURSIVE ed AS (SELECT DISTINCT o_custkey AS u, l_partkey + 1000000000 AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey), bi AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT u AS node, u AS component FROM bi
  UNION (SELECT bi.u AS node, min(c.component) AS component FROM cc c JOIN bi ON bi.v = c.node JOIN recurring.cc r ON r.node = bi.u WHERE c.component < r.component GROUP BY bi.u))
SELECT node, component FROM cc""")
def merge_components(spark, d):
    """Components of the graph of customers and the parts they order."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return V.label_components(edges.select(F.col("o_custkey").alias("u"), (F.col("l_partkey") + 1_000_000_000).alias("v")).distinct())
