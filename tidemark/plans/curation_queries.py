"""Gates and choices of curation on the lineitem, part, orders, events and embeddings tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import curation as C

from .bindings import FACTS, GAPS, TIMELINE, facts, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT l_orderkey AS "order", l_partkey AS part, l_linenumber AS current, CASE WHEN l_partkey % 17 = 0 THEN 'frame' ELSE 'c' || lpad(CAST(l_suppkey % 9 AS VARCHAR), 5, '0') || '@1' END AS rep,
  '/runs/' || l_orderkey AS run, CASE WHEN l_suppkey % 5 = 0 THEN '/elsewhere/a.png' ELSE '/runs/' || l_orderkey || '/a.png' END AS img, l_suppkey FROM lineitem)
SELECT "order", part, current, CASE WHEN rep = 'frame' THEN 'no_source' WHEN l_suppkey % 9 >= current THEN 'not_earlier' ELSE 'outside_run' END AS reason FROM r
WHERE rep = 'frame' OR l_suppkey % 9 >= current OR l_suppkey % 5 = 0""")
def causal_check(spark, d):
    """References that are no strictly earlier still of their own run."""
    s = F.col("l_suppkey")
    run = F.concat(F.lit("/runs/"), F.col("l_orderkey").cast("string"))
    refs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("current"), run.alias("run"),
        F.when(F.col("l_partkey") % 17 == 0, "frame").otherwise(F.format_string("c%05d@1", s % 9)).alias("representation_id"),
        F.when(s % 5 == 0, "/elsewhere/a.png").otherwise(F.concat(run, F.lit("/a.png"))).alias("image_ref"),
    )
    return C.causal_violations(refs).select("order", "part", "current", "reason")


PARTS_SQL = """e AS (SELECT p_partkey % 50 AS movie, p_partkey AS entity_id, CASE p_partkey % 3 WHEN 0 THEN 'character' WHEN 1 THEN 'prop' ELSE 'location' END AS kind,
  p_name || CASE p_size % 5 WHEN 0 THEN ' rock' WHEN 1 THEN '_River' WHEN 2 THEN ' of the lake' ELSE '' END AS name FROM part)"""


def part_entities(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size") % 5
    kind = F.when(k % 3 == 0, "character").when(k % 3 == 1, "prop").otherwise("location")
    end = F.when(z == 0, " rock").when(z == 1, "_River").when(z == 2, " of the lake").otherwise("")
    return table(spark, d, "part").select((k % 50).alias("movie"), k.alias("entity_id"), kind.alias("kind"), F.concat("p_name", end).alias("name"))


@query(f"""WITH {PARTS_SQL}, w AS (SELECT *, list_filter(string_split(replace(lower(name), '_', ' '), ' '), lambda x: x <> '') AS ws FROM e),
cw AS (SELECT DISTINCT movie, unnest(ws) AS word FROM w WHERE kind = 'character'),
hit AS (SELECT o.movie, entity_id, string_agg(DISTINCT o.word, ',' ORDER BY o.word) AS hits FROM (SELECT DISTINCT movie, entity_id, unnest(ws) AS word FROM w WHERE kind <> 'character') o
  JOIN cw USING (movie, word) WHERE o.word NOT IN ('a', 'of', 'the', 'with') GROUP BY 1, 2),
f AS (SELECT w.movie, w.entity_id, concat_ws('; ', CASE WHEN kind = 'prop' AND ws[-1] IN {C.PLACE_WORDS} THEN 'prop named like a place (' || ws[-1] || ')' END,
  CASE WHEN kind = 'location' AND ws[-1] IN {C.THING_WORDS} THEN 'location named like a thing (' || ws[-1] || ')' END,
  CASE WHEN hits IS NOT NULL THEN 'names a character''s word: ' || hits END) AS flags FROM w LEFT JOIN hit USING (movie, entity_id) WHERE kind <> 'character')
SELECT * FROM f WHERE flags <> ''""")
def kind_mixture(spark, d):
    """Entities whose names speak against their kind."""
    return C.kind_mixtures(part_entities(spark, d))


@query("""SELECT l_orderkey AS shot, bool_or((l_partkey % 900 + 100) * (l_suppkey % 10 * 100 + 50) / 1e6 > 0.4) AS closeup FROM lineitem GROUP BY 1""")
def closeup_shots(spark, d):
    """Shots in which one box covers two fifths of the frame."""
    box = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("l_partkey") % 900 + 100, F.col("l_suppkey") % 10 * 100 + 50)
    shots = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("shot")).agg(F.collect_list(box).alias("boxes"))
    return C.closeups(shots, 0.4).select("shot", "closeup")


@query("""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN ['blurry', ' blurry '] WHEN o_custkey % 4 = 1 THEN ['identity_mismatch', ''] END AS qa,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS accepted, CASE o_custkey % 5 WHEN 0 THEN 'coverage_acquire' WHEN 1 THEN ' late ' WHEN 2 THEN '' END AS reason,
  CASE WHEN o_orderkey % 9 = 0 THEN 'slot_bind' WHEN o_orderkey % 2 = 0 THEN 'acquire' END AS task_kind, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'a.png' END AS crop_path FROM orders),
r AS (SELECT *, list_concat(CASE WHEN qa IS NULL THEN [] WHEN qa[1] = 'blurry' THEN ['blurry'] ELSE ['identity_mismatch'] END,
  CASE WHEN accepted = false THEN [CASE WHEN coalesce(reason, '') <> '' THEN reason ELSE 'not_accepted' END] WHEN reason = ' late ' THEN ['late'] ELSE [] END) AS rs FROM p)
SELECT k, array_to_string(rs, ',') AS reasons, coalesce(task_kind, '') = 'slot_bind' OR coalesce(accepted = false, false) OR trim(crop_path) = '' OR list_has_any(rs, ['identity_mismatch', 'not_accepted']) AS hidden FROM r""")
def review_reasons(spark, d):
    """Reasons of crop proposals and whether people see them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        k.alias("k"), F.when(c % 4 == 0, F.array(F.lit("blurry"), F.lit(" blurry "))).when(c % 4 == 1, F.array(F.lit("identity_mismatch"), F.lit(""))).alias("qa_reasons"),
        F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("accepted"),
        F.when(c % 5 == 0, "coverage_acquire").when(c % 5 == 1, " late ").when(c % 5 == 2, "").alias("reason"),
        F.when(k % 9 == 0, "slot_bind").when(k % 2 == 0, "acquire").alias("task_kind"), F.when(k % 11 == 0, " ").otherwise("a.png").alias("crop_path"),
    )
    return C.crop_reasons(rows).select("k", F.concat_ws(",", "reasons").alias("reasons"), "hidden")


@query("""SELECT o_orderkey AS segment_id, f AS final, f = 'BLOCK' AS blocks FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PASS' ELSE 'BLOCK' END
  WHEN o_custkey % 3 = 0 THEN 'WARN' WHEN o_orderstatus = 'O' THEN 'PASS' ELSE 'BLOCK' END AS f FROM orders)""")
def freeze_gate(spark, d):
    """Final verdicts after overrides, and which of them block a freeze."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    reviews = o.select(k.alias("segment_id"), F.when(F.col("o_custkey") % 3 == 0, "WARN").when(F.col("o_custkey") % 3 == 1, "").alias("verdict"), (F.col("o_orderstatus") == "O").alias("accepted"))
    overrides = o.where(k % 7 == 0).select(k.alias("segment_id"), F.when(k % 2 == 0, "PASS").otherwise("BLOCK").alias("resolved"))
    return C.final_verdicts(reviews, overrides).select("segment_id", "final", "blocks")


@query("""SELECT c_custkey AS movie, CASE WHEN k % 11 = 0 THEN 'complete' WHEN k % 7 = 0 THEN 'after_s6' WHEN k % 5 = 0 OR k % 3 = 0 THEN 'awaiting_human' WHEN k % 4 = 1 THEN 'after_s4' WHEN k % 2 = 0 THEN 'awaiting_human' ELSE 'pipeline' END AS action
  FROM (SELECT c_custkey, c_custkey AS k FROM customer)""")
def resume_actions(spark, d):
    """How each movie goes on, from what its folders hold."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("movie"), (k % 11 == 0).alias("published"), (k % 7 == 0).alias("s6_reviewed"), (k % 5 == 0).alias("proposals"), (k % 3 == 0).alias("s6_queue"),
        (k % 4 == 1).alias("s4_reviewed"), (k % 2 == 0).alias("s4_queue"),
    )
    return C.resume_action(rows).select("movie", "action")


@query("""WITH i AS (SELECT c_nationkey AS cluster, c_custkey AS seq, 'http://h' || (c_custkey % 9) AS url, c_mktsegment = 'BUILDING' AS fits FROM customer WHERE c_acctbal > 0 AND c_custkey % 6 <> 0 AND c_custkey % 13 <> 0),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY cluster, url ORDER BY seq) = 1)
SELECT cluster, seq, url FROM f QUALIFY fits = max(fits) OVER (PARTITION BY cluster)""")
def dispatch_targets(spark, d):
    """Urls of each cluster that reviews may go to."""
    k = F.col("c_custkey")
    url = F.when(k % 13 == 0, "/").when(k % 2 == 0, F.format_string("http://h%d/", k % 9)).otherwise(F.format_string("http://h%d", k % 9))
    rows = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("cluster"), k.alias("seq"), url.alias("url"), F.when(F.col("c_mktsegment") == "BUILDING", "any").otherwise("annotator").alias("role"),
        (F.col("c_acctbal") > 0).alias("online"), (k % 6 == 0).alias("on_break"),
    )
    return C.dispatch_urls(rows, ["cluster"], role="reviewer")


GATE_BOX = "[l_suppkey % 3 * 100, 0, l_suppkey % 3 * 100 + 300, CASE WHEN l_partkey % 29 = 0 THEN 4000 ELSE 500 END]"


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_suppkey % 3 AS y, l_partkey % 29 = 0 AS big, l_partkey % 4 <> 0 AS gated FROM lineitem),
pr AS (SELECT x.chunk, x.seq AS a, z.seq AS c, row_number() OVER (PARTITION BY x.chunk ORDER BY x.seq, z.seq) AS k FROM b x JOIN b z ON x.chunk = z.chunk AND x.seq < z.seq AND x.y = z.y WHERE x.gated AND z.gated AND NOT x.big AND NOT z.big),
st AS (SELECT chunk, 0 AS k, [] :: BIGINT[] AS done FROM (SELECT DISTINCT chunk FROM b)
  UNION ALL SELECT s.chunk, CAST(p.k AS INTEGER), CASE WHEN list_contains(done, p.a) OR list_contains(done, p.c) THEN done ELSE list_concat(done, [p.a, p.c]) END FROM st s JOIN pr p ON p.chunk = s.chunk AND p.k = s.k + 1),
fin AS (SELECT chunk, arg_max(done, k) AS done FROM st GROUP BY 1)
SELECT b.chunk, CAST(seq AS BIGINT) AS seq, (gated AND big) OR list_contains(done, seq) AS blocked FROM b JOIN fin USING (chunk)""")
def perception_blocks(spark, d):
    """Crops that a gate blocks: too large, or sharing a box with another one."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    y = F.col("l_suppkey") % 3 * 100
    wide = F.when(F.col("l_partkey") % 29 == 0, 4000).otherwise(500).cast("long")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chunk"), F.row_number().over(order).cast("long").alias("seq"), F.when(F.col("l_partkey") % 8 == 0, "location").otherwise("prop").alias("kind"),
        F.when(F.col("l_partkey") % 4 == 0, "fullframe").otherwise("grounding_dino").alias("bbox_source"), F.array(y, F.lit(0).cast("long"), y + 300, wide).alias("bbox"),
    )
    return C.perception_gate(rows, 0.95, 0.95).select("chunk", "seq", "blocked")


@query(f"""WITH {TIMELINE}, {GAPS}, {FACTS} SELECT story, idx, array_to_string(list(last_seen ORDER BY gap DESC, eid), ',') AS sources FROM fx WHERE last_seen IS NOT NULL AND kind IN ('character', 'prop') GROUP BY story, idx""")
def last_seen_sources(spark, d):
    """Where the entities of each segment were last seen."""
    rows = C.seen_before_plan(facts(spark, d))
    return rows.select("story", "idx", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


SIM = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) % 100 / 128.0 END"


def similarity_units(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    sim = F.when(k % 5 != 0, F.floor("value").cast("int") % 100 / 128.0)
    return e.select(F.col("event_type").alias("modality"), (k % 3 != 0).alias("det_a"), (k % 4 != 0).alias("det_b"), sim.alias("sim"), (F.floor("value").cast("int") + k % 60 > 60).alias("positive"))


@query(f"""WITH u AS (SELECT event_type AS modality, event_id % 3 <> 0 AS a, event_id % 4 <> 0 AS b, {SIM} AS sim FROM events)
SELECT modality, count(*) AS n, round(count(*) FILTER (sim >= 0.5) / count(*), 4) AS consistent_rate, round(count(*) FILTER (sim >= 0.5) / count(sim), 4) AS consistent_given_both, round(sum(sim) / count(sim), 4) AS mean_similarity,
  round(count(*) FILTER (a) / count(*), 4) AS detected_a_rate, round(count(*) FILTER (b) / count(*), 4) AS detected_b_rate, round(count(sim) / count(*), 4) AS both_detected_rate FROM u GROUP BY 1""")
def embedding_rates(spark, d):
    """Detection and consistency rates of each modality."""
    return C.similarity_rates(similarity_units(spark, d), ["modality"], 0.5)


@query(f"""WITH u AS (SELECT event_type AS modality, {SIM} AS sim, CAST(floor(value) AS INTEGER) + event_id % 60 > 60 AS pos FROM events),
c AS (SELECT modality, sim, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM u WHERE sim IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, sum(p) OVER d AS pu, sum(n) OVER d AS nu, sum(p) OVER a AS pt, sum(n) OVER a AS nt, sum(n) OVER (PARTITION BY modality ORDER BY sim) - n AS below FROM c WINDOW d AS (PARTITION BY modality ORDER BY sim DESC), a AS (PARTITION BY modality)),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY modality ORDER BY pu * nt - nu * pt DESC, sim) = 1),
g AS (SELECT modality, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 4) AS auc FROM w GROUP BY 1)
SELECT g.*, round(sim, 6) AS threshold, round(pu / pt, 4) AS tpr, round(nu / nt, 4) AS fpr, round(pu / pt - nu / nt, 4) AS youden_j, round(1 - nu / nt, 4) AS neg_below_threshold FROM g JOIN b USING (modality)""")
def calibrated_thresholds(spark, d):
    """Counts, AUC and threshold of each modality from its controls."""
    return C.calibration(similarity_units(spark, d), ["modality"], "sim", "positive")


@query("""WITH r AS (SELECT l_partkey % 50 AS movie, l_suppkey AS entity_id, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE l_discount END AS s, l_linenumber AS f, l_orderkey || '_' || l_linenumber || '_' || l_partkey AS rep FROM lineitem WHERE l_orderkey % 6 <> 0)
SELECT movie, entity_id, rep AS representation_id, 'crops/' || rep AS crop_path FROM r QUALIFY row_number() OVER (PARTITION BY movie, entity_id ORDER BY s DESC, f, rep DESC) = 1""")
def representative_crop(spark, d):
    """The crop that stands for each entity."""
    rep = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 50).alias("movie"), F.col("l_suppkey").alias("entity_id"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount")).alias("grounding_score"),
        F.col("l_linenumber").alias("frame_index"), rep.alias("representation_id"), F.when(F.col("l_orderkey") % 6 == 0, "").otherwise(F.concat(F.lit("crops/"), rep)).alias("crop_path"),
    )
    return C.representative_crops(rows)


@query("""WITH r AS (SELECT l_orderkey AS item, 'k' || (l_orderkey % 7) AS current, 'k' || (l_suppkey % 7) AS label, max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY ALL),
t AS (SELECT item, current, arg_max(label, (q, -CAST(substr(label, 2) AS INTEGER))) AS top, max(q) AS q, coalesce(max(q) FILTER (label = current), 0) AS own FROM r GROUP BY 1, 2)
SELECT item, CASE WHEN top <> current AND q - own >= 16 THEN top ELSE current END AS label FROM t""")
def reassigned_labels(spark, d):
    """Labels after a reassignment by a margin."""
    li = table(spark, d, "lineitem")
    k = F.col("l_suppkey") % 7
    rows = li.groupBy(F.col("l_orderkey").alias("item"), F.concat(F.lit("k"), (F.col("l_orderkey") % 7).cast("string")).alias("current"), k.alias("seq")).agg(F.max(F.col("l_quantity").cast("int")).alias("prob"))
    rows = rows.withColumn("label", F.concat(F.lit("k"), F.col("seq").cast("string")))
    return C.reassigned(rows, "item", 16)


@query("""WITH s AS (SELECT l_orderkey % 40 AS chunk, l_partkey AS candidate, l_suppkey % 5 AS entity, max(CAST(l_quantity AS INTEGER)) AS sim FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(sim) OVER w AS nx FROM s WINDOW w AS (PARTITION BY chunk, candidate ORDER BY sim DESC, entity)),
a AS (SELECT * FROM r WHERE r = 1 AND sim >= 28 AND coalesce(sim - nx, 9) >= 6)
SELECT chunk, entity, candidate, sim FROM a QUALIFY row_number() OVER (PARTITION BY chunk, entity ORDER BY sim DESC, candidate DESC) = 1""")
def exclusive_exemplars(spark, d):
    """One candidate for each entity, by exemplars, with a floor and a margin."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("chunk"), F.col("l_partkey").alias("candidate"), (F.col("l_suppkey") % 5).alias("entity"), F.col("l_quantity").cast("int").alias("sim")
    )
    return C.exclusive_assignment(rows, ["chunk"], 28, 6)


@query("""WITH p AS (SELECT p_partkey % 50 AS movie, p_partkey AS seq, lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN ' old' ELSE '' END AS phrase FROM part),
l AS (SELECT DISTINCT p_partkey % 50 AS movie, p_type || ' ' || split_part(p_name, ' ', 2) AS label FROM part),
x AS (SELECT movie, label, unnest(list_distinct(string_split(lower(label), ' '))) AS word FROM l), y AS (SELECT movie, seq, phrase, unnest(list_distinct(string_split(phrase, ' '))) AS word FROM p),
n AS (SELECT x.movie, label, seq, phrase, count(*) AS n_shared FROM x JOIN y ON x.movie = y.movie AND x.word = y.word GROUP BY ALL)
SELECT movie, label, phrase, n_shared FROM n QUALIFY row_number() OVER (PARTITION BY movie, label ORDER BY n_shared DESC, seq) = 1""")
def phrase_match(spark, d):
    """The roster phrase that each label belongs to."""
    p = table(spark, d, "part")
    movie = (F.col("p_partkey") % 50).alias("movie")
    phrases = p.select(movie, F.col("p_partkey").alias("seq"), F.concat(F.lower("p_name"), F.when(F.col("p_partkey") % 2 == 0, " old").otherwise("")).alias("phrase"))
    return C.matched_phrases(p.select(movie, F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("label")), phrases, ["movie"])


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey AS rep FROM lineitem WHERE l_partkey % 40 <> 0), b AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey AS rep FROM lineitem WHERE l_partkey % 50 <> 0),
x AS (SELECT coalesce(a.chunk, b.chunk) AS chunk, b.rep IS NULL AS m, a.rep IS NULL AS e FROM a FULL JOIN b ON a.chunk = b.chunk AND a.rep = b.rep)
SELECT chunk, count(*) FILTER (m) AS n_missing, count(*) FILTER (e) AS n_extra FROM x GROUP BY 1 HAVING count(*) FILTER (m) > 0 OR count(*) FILTER (e) > 0""")
def table_differences(spark, d):
    """Chunks in which two forbidden tables differ."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("rep"), "l_partkey")
    return C.set_differences(li.where("l_partkey % 40 != 0"), li.where("l_partkey % 50 != 0"), ["chunk"], ["rep"])


@query("""WITH f AS (SELECT l_orderkey AS chunk, l_returnflag || (l_suppkey % 3) AS detail, min(l_linenumber * 1000000 + l_partkey) AS seq FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 4 <> 0 GROUP BY 1, 2)
SELECT chunk, string_agg(detail, '|' ORDER BY seq, detail) AS feedback FROM f GROUP BY 1""")
def feedback_union(spark, d):
    """Details of failed checks, once each."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chunk"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), (F.col("l_linestatus") != "F").alias("passed"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat("l_returnflag", (F.col("l_suppkey") % 3).cast("string"))).alias("detail"),
    )
    return C.united_feedback(rows, ["chunk"]).select("chunk", F.array_join("feedback", "|").alias("feedback"))


@query("""SELECT c_nationkey AS nation, c_custkey AS decoy, CAST(row_number() OVER w AS INTEGER) AS place FROM customer
WINDOW w AS (PARTITION BY c_nationkey ORDER BY sha256('decoy:' || c_nationkey || ':' || c_custkey), c_custkey) QUALIFY row_number() OVER w <= 3""")
def decoy_sample(spark, d):
    """Three decoys of each nation by a keyed hash."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("decoy"))
    return C.keyed_decoys(rows, ["nation"], "decoy", 3, "decoy")


@query("""WITH p AS (SELECT o_orderkey AS k, CASE o_custkey % 6 WHEN 0 THEN 'assets/props/p1/a.png' WHEN 1 THEN 'assets/p1/a.png' WHEN 2 THEN 'derived/assets/p1/a.png' WHEN 3 THEN 'x/tmp/a.png' WHEN 4 THEN 'assets/a.png' END AS path FROM orders)
SELECT k, CASE WHEN regexp_matches(path, '^assets/(characters|props|locations)/[^/]+/') THEN 'bank' WHEN regexp_matches(path, '^assets/[^/]+/') THEN 'flat' WHEN regexp_matches(path, '^derived/assets/[^/]+/') THEN 'derived'
  WHEN regexp_matches(path, '(^|/)tmp/') THEN 'candidate' ELSE 'other' END AS layout FROM p""")
def path_layouts(spark, d):
    """Which layout each crop path follows."""
    c = F.col("o_custkey") % 6
    path = F.when(c == 0, "assets/props/p1/a.png").when(c == 1, "assets/p1/a.png").when(c == 2, "derived/assets/p1/a.png").when(c == 3, "x/tmp/a.png").when(c == 4, "assets/a.png")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), C.legacy_path(path).alias("layout"))


@query("""WITH c AS (SELECT l_suppkey AS entity_id, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, (l_partkey % 30) || '.png' AS leaf, l_extendedprice AS x FROM lineitem),
d AS (SELECT entity_id, leaf, arg_max(CASE WHEN p % 2 = 0 THEN 'keep' ELSE 'reject' END, k * 10 + n) AS decision FROM c WHERE k % 97 = 0 GROUP BY 1, 2)
SELECT c.entity_id, k, n, p, decision FROM c LEFT JOIN d USING (entity_id, leaf)""")
def sibling_decision(spark, d):
    """Decisions spread to the crops of the same entity and file name."""
    leaf = F.concat((F.col("l_partkey") % 30).cast("string"), F.lit(".png"))
    crops = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("a/b/"), leaf)).otherwise(F.concat(F.lit("c\\"), leaf)).alias("crop_path"),
    )
    made = crops.where("k % 97 = 0").select("entity_id", "crop_path", (F.col("k") * 10 + F.col("n")).alias("seq"), F.when(F.col("p") % 2 == 0, "keep").otherwise("reject").alias("decision"))
    return C.sibling_decisions(made, crops).select("entity_id", "k", "n", "p", "decision")


@query("""SELECT c_custkey AS movie, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'registry' END, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'chunks' END, CASE WHEN c_custkey % 7 = 0 THEN 'crops' END) AS missing,
  c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS ready FROM customer""")
def gold_readiness(spark, d):
    """What each movie lacks before it can be published."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("movie"), (k % 2 != 0).alias("registry"), F.when(k % 5 != 0, k % 3 != 0).alias("chunks"), (k % 7 != 0).alias("crops"))
    return C.readiness(rows, ["registry", "chunks", "crops"]).select("movie", "missing", "ready")


@query("""SELECT o_orderkey AS k, CASE o_custkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN NULL WHEN 2 THEN '' END AS ids FROM orders""")
def strict_answers(spark, d):
    """Answers that name only what they may."""
    c = F.col("o_custkey") % 4
    text = F.when(c == 0, '{"entity_ids": ["b", "a", "b"]}').when(c == 1, '{"entity_ids": ["z"]}').when(c == 2, '{"entity_ids": []}').otherwise("no answer")
    answer = C.strict_answer(text, F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(answer.isNotNull(), F.array_join(answer, ",")).alias("ids"))
