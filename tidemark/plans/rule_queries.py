"""Scalars, filters, verdicts, rule sets, sampling and kernels; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import kernels as K
from tidemark.operators import rules as R

from .bindings import PRESENCE, TIMELINE, presence, table, timeline
from .identity_queries import linked_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '"' || p_name || '" (Prop)' WHEN 1 THEN p_name || ' -char' WHEN 2 THEN p_name || '_loc' WHEN 3 THEN p_name || ' Location' ELSE '  ' || p_name || ' ' END AS raw FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '(?i)\\s*\\(\\s*(?:character|location|prop|char|loc)\\s*\\)?\\s*$', ''),
  '(?i)\\s+-(?:character|location|prop|char|loc)\\s*$', ''), '(?i)\\s+(?:character|location|prop|char|loc)\\s*$', ''), '(?i)[_-](?:character|location|prop|char|loc)$', ''), '^["'']+|["'']+$', '', 'g')) AS name FROM n)
SELECT p_partkey, name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM c""")
def entity_names(spark, d):
    """Names without their kind suffix, and slugs."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit('"'), "p_name", F.lit('" (Prop)'))).when(k == 1, F.concat("p_name", F.lit(" -char")))
        .when(k == 2, F.concat("p_name", F.lit("_loc"))).when(k == 3, F.concat("p_name", F.lit(" Location"))).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    )
    return p.select("p_partkey", X.entity_name(raw).alias("name"), X.slug(raw).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(k AS VARCHAR))) AS INT), '0') END AS entity_id FROM (
  SELECT p_partkey, replace(p_name, ' ', '_') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def entity_ids(spark, d):
    """Ids made unique by number."""
    place = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", X.numbered(F.replace("p_name", F.lit(" "), F.lit("_")), place).alias("entity_id"))


@query("""WITH n AS (SELECT conv_id, string_split(text, ' ')[1] AS w FROM conversations WHERE turn = 0)
SELECT c.conv_id, c.turn, contains(' ' || regexp_replace(lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || lower(w) || ' ') AS hit
FROM conversations c JOIN n USING (conv_id) WHERE c.turn > 0 AND regexp_full_match(w, '[A-Za-z]+')""")
def name_mentions(spark, d):
    """Whether later turns mention the name that opens their conversation, at token boundaries."""
    c = table(spark, d, "conversations")
    names = c.where("turn = 0").select("conv_id", F.split("text", " ")[0].alias("w")).where(F.col("w").rlike("^[A-Za-z]+$"))
    return c.where("turn > 0").join(names, "conv_id").select("conv_id", "turn", X.name_in(F.col("w"), F.col("text")).alias("hit"))


@query("""SELECT l_orderkey, l_linenumber, 'base' || CAST(l_suppkey % 7 AS VARCHAR) AS base, CASE l_linenumber % 3 WHEN 0 THEN 'description_provided' WHEN 1 THEN 'description_only' ELSE 'name_anchored' END AS mode,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS INT) END AS budget, count(*) AS n FROM lineitem GROUP BY ALL""")
def run_name_round_trip(spark, d):
    """Run names built and parsed again."""
    mode = F.when(F.col("l_linenumber") % 3 == 0, "description_provided").when(F.col("l_linenumber") % 3 == 1, "description_only").otherwise("name_anchored")
    name = X.run_name(F.concat(F.lit("base"), (F.col("l_suppkey") % 7).cast("string")), mode, F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.parsed_run_name(name).alias("r"))
    return rows.groupBy("l_orderkey", "l_linenumber", "r.base", "r.mode", "r.budget").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def repaired_json(spark, d):
    """JSON read from prose with single quotes and trailing commas."""
    broken = F.concat(F.lit("answer: "), F.regexp_replace(F.translate("props", '"', "'"), r"\}", ",}"), F.lit(" end"))
    raw = F.when(F.col("event_id") % 2 == 0, broken).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", X.repaired_json(raw, "k long")["k"].alias("k"))


@query("""SELECT CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', '0') THEN 'false' ELSE 'unsure' END AS answer, count(*) AS n
FROM (SELECT CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'no' WHEN 3 THEN 'TRUE' WHEN 4 THEN '0' WHEN 5 THEN NULL ELSE 'maybe' END AS v FROM lineitem) GROUP BY 1""")
def tri_states(spark, d):
    """Answers as true, false or unsure."""
    n = F.col("l_linenumber")
    v = F.when(n == 1, "Yes").when(n == 2, "no").when(n == 3, "TRUE").when(n == 4, "0").when(n == 5, None).otherwise("maybe")
    return table(spark, d, "lineitem").groupBy(X.tri_state(v).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT item_id, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 6), ' ') AS short FROM benchmark""")
def short_descriptions(spark, d):
    """The first words of a description."""
    return table(spark, d, "benchmark").select("item_id", X.short_description(F.col("text"), 6).alias("short"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) IN ('economy', 'standard') THEN lower(p_type) ELSE 'unknown' END AS kind FROM part""")
def enum_fallback(spark, d):
    """Enum values with a fallback."""
    return table(spark, d, "part").select("p_partkey", X.known(F.col("p_type"), ["economy", "standard"]).alias("kind"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '"}') AS digest FROM customer""")
def content_hashes(spark, d):
    """Content hash of a row's JSON."""
    return table(spark, d, "customer").select("c_custkey", X.content_hash(F.col("c_custkey"), F.col("c_mktsegment")).alias("digest"))


@query("""WITH h AS (SELECT item_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00'::BLOB) || sha256(encode(text) || '\\x00\\x00\\x00\\x01'::BLOB) || sha256(encode(text) || '\\x00\\x00\\x00\\x02'::BLOB) || sha256(encode(text) || '\\x00\\x00\\x00\\x03'::BLOB) AS d FROM benchmark),
r AS (SELECT item_id, list_transform(range(64), lambda i: CAST('0x' || substr(d, i * 4 + 1, 4) AS INTEGER) / 65535.0 * 2.0 - 1.0) AS v FROM h), s AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM r)
SELECT item_id, CAST(len(v) AS INTEGER) AS dim, round(v[1] / size, 6) AS first, round(list_sum(list_transform(v, lambda x: (x / size) * (x / size))), 6) AS norm FROM s""")
def hash_embeddings(spark, d):
    """Deterministic vectors from a text's hash."""
    v = table(spark, d, "benchmark").select("item_id", X.hash_vector(F.col("text")).alias("v"))
    return v.select("item_id", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query(f"""WITH {TIMELINE}, ch AS (SELECT story, idx AS chunk_id, sec AS lo, sec + 600 AS hi FROM tl),
it AS (SELECT story, event_id AS item, idx AS at_chunk, CASE WHEN event_id % 3 = 0 THEN sec - 900 + event_id % 1800 END AS seconds, idx - 1 + event_id % 3 AS source_chunk FROM tl),
r AS (SELECT it.story, it.item, it.seconds, o.lo AS own_lo, (s.lo + s.hi) / 2.0 AS mid FROM it LEFT JOIN ch o ON o.story = it.story AND o.chunk_id = it.at_chunk LEFT JOIN ch s ON s.story = it.story AND s.chunk_id = it.source_chunk)
SELECT CASE WHEN own_lo IS NULL THEN 'no_chunk' WHEN coalesce(seconds, mid) IS NULL THEN 'unresolved' WHEN coalesce(seconds, mid) >= own_lo THEN 'future' WHEN seconds IS NULL THEN 'from_chunk' ELSE 'from_seconds' END AS fate, count(*) AS n FROM r GROUP BY 1""")
def causal_materialisation(spark, d):
    """Items resolved to a time, and those dropped because it isn't in the past."""
    t = timeline(spark, d)
    chunks = t.select("story", F.col("idx").alias("chunk_id"), F.col("sec").alias("lo"), (F.col("sec") + 600).alias("hi"))
    items = t.select(
        "story", F.col("event_id").alias("item"), F.col("idx").alias("at_chunk"),
        F.when(F.col("event_id") % 3 == 0, F.col("sec") - 900 + F.col("event_id") % 1800).alias("seconds"), (F.col("idx") - 1 + F.col("event_id") % 3).alias("source_chunk"),
    )
    return R.materialised(items, chunks).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_orderkey, o_totalprice > 200000 AS ok, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf, o_orderkey % 17 = 0 AS retry, o_orderkey % 13 = 0 AS det, o_orderkey % 2 = 0 AS trusted FROM orders)
SELECT CASE WHEN retry THEN 'RETRYABLE_ERROR' WHEN det THEN 'BLOCK' WHEN conf = 'high' AND NOT ok THEN 'BLOCK' WHEN trusted AND conf IN ('low', 'medium') AND NOT ok THEN 'PASS' WHEN NOT ok OR conf IN ('low', 'medium') THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) AS n FROM r GROUP BY 1""")
def review_verdicts(spark, d):
    """Verdicts by precedence."""
    return _verdicts(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _verdicts(spark, d):
    k = F.col("o_orderkey")
    conf = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    verdict = R.review_verdict(F.col("o_totalprice") > 200000, conf, k % 17 == 0, k % 13 == 0, k % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", verdict.alias("verdict"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'RETRYABLE_ERROR' WHEN o_orderkey % 13 = 0 THEN 'BLOCK' WHEN o_orderkey % 3 = 0 AND o_totalprice <= 200000 THEN 'BLOCK'
  WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 != 0 AND o_totalprice <= 200000 THEN 'PASS' WHEN o_totalprice <= 200000 OR o_orderkey % 3 != 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM orders),
e AS (SELECT * FROM r WHERE verdict != 'RETRYABLE_ERROR'), n AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'WARN') AS w, count(*) FILTER (verdict = 'PASS') AS p FROM e),
q AS (SELECT w, p, least(w + p, greatest(3, CAST(round_even(n * 0.05, 0) AS BIGINT))) AS k FROM n), q2 AS (SELECT *, least(p, greatest(1, CAST(round_even(k * p / CAST(w + p AS DOUBLE), 0) AS BIGINT)), k - 1) AS qp FROM q),
q3 AS (SELECT least(w, k - qp) AS q_warn, least(p, k - least(w, k - qp)) AS q_pass FROM q2),
o AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY sha256('s4:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM e)
SELECT o_orderkey, verdict FROM o, q3 WHERE verdict = 'BLOCK' OR (verdict = 'WARN' AND place <= q_warn) OR (verdict = 'PASS' AND place <= q_pass)""")
def stratified_review_sample(spark, d):
    """All blocks and a proportional sample of the rest, in the order of a keyed hash."""
    return R.stratified_sample(_verdicts(spark, d), "o_orderkey", 0.05, 3, "s4")


@query("""WITH e AS (SELECT event_id, value < 5 AS rev, CASE event_type WHEN 'view' THEN 'broken' WHEN 'click' THEN 'consumed' WHEN 'error' THEN '' ELSE 'odd' END AS explicit,
  CASE WHEN event_id % 4 = 0 THEN 'broken' WHEN event_id % 4 = 1 THEN 'acquired' END AS inferred, CASE WHEN event_id % 5 != 0 THEN ['broken', 'acquired'] END AS allowed FROM events),
f AS (SELECT *, coalesce(CASE WHEN explicit IN ('broken', 'consumed', 'acquired') THEN explicit END, inferred) AS kind FROM e)
SELECT coalesce(CASE WHEN rev THEN 'reversible' WHEN kind IS NULL THEN 'unknown' WHEN explicit != '' AND inferred IS NOT NULL AND explicit != inferred THEN 'mismatch'
  WHEN allowed IS NOT NULL AND NOT list_contains(allowed, kind) THEN 'not_allowed' END, 'kept') AS fate, count(*) AS n FROM f GROUP BY 1""")
def state_event_filter(spark, d):
    """State events kept or rejected, with the reason."""
    e = table(spark, d, "events")
    explicit = F.when(F.col("event_type") == "view", "broken").when(F.col("event_type") == "click", "consumed").when(F.col("event_type") == "error", "").otherwise("odd")
    inferred = F.when(F.col("event_id") % 4 == 0, "broken").when(F.col("event_id") % 4 == 1, "acquired")
    allowed = F.when(F.col("event_id") % 5 != 0, F.array(F.lit("broken"), F.lit("acquired")))
    fate = R.event_fate(F.col("value") < 5, explicit, inferred, ["broken", "consumed", "acquired"], allowed)
    return e.groupBy(F.coalesce(fate, F.lit("kept")).alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TIMELINE}, f AS (SELECT story, idx, value < 40 AS dark FROM tl), b AS (SELECT story, min(idx) FILTER (NOT dark) AS lo, max(idx) FILTER (NOT dark) AS hi FROM f GROUP BY story)
SELECT f.story, f.idx, CAST(row_number() OVER (PARTITION BY f.story ORDER BY f.idx) AS INT) AS place FROM f JOIN b USING (story) WHERE dark AND (lo IS NULL OR idx < lo OR idx > hi)""")
def credit_segments(spark, d):
    """Flagged runs that touch the head or tail of a story."""
    t = timeline(spark, d).select("story", "idx", (F.col("value") < 40).alias("dark"))
    return R.runs_at_ends(t, ["story"], "idx", "dark").select("story", "idx", "place")


@query(f"""WITH {PRESENCE}, dup AS (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1),
nc AS (SELECT story, idx, coalesce(lag(idx) OVER (PARTITION BY story ORDER BY idx) + 1, 0) AS want FROM (SELECT DISTINCT story, idx FROM pr))
SELECT 'duplicate_name' AS code, 'error' AS severity, p_name AS path FROM dup
UNION ALL SELECT 'non_contiguous_chunks', 'error', story || '/' || idx FROM nc WHERE idx != want
UNION ALL SELECT 'unknown_entity', 'error', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900)
UNION ALL SELECT 'oversized', 'warn', CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_quantity * l_discount > 4.5""")
def lint(spark, d):
    """Findings of a rule set."""
    known = table(spark, d, "customer").where("c_acctbal > -900").select(F.col("c_custkey").alias("o_custkey"))
    chunks = presence(spark, d).select("story", "idx").distinct()
    return R.findings(
        [
            ("duplicate_name", "error", R.duplicates(table(spark, d, "part"), "p_name"), F.col("p_name")),
            ("non_contiguous_chunks", "error", R.not_contiguous(chunks, ["story"], "idx"), F.concat_ws("/", F.col("story").cast("string"), F.col("idx").cast("string"))),
            ("unknown_entity", "error", table(spark, d, "orders").join(known, "o_custkey", "left_anti"), F.col("o_orderkey")),
            ("oversized", "warn", table(spark, d, "lineitem").where("l_quantity * l_discount > 4.5"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))),
        ]
    )


@query("""SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 4 = 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def resume_work_list(spark, d):
    """Jobs of one shard without a result."""
    o = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.work_list(o, done, ["o_orderkey"], 1, 4)


def _items(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("label", F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), (F.col("vec_id") * 37 % 101).cast("double").alias("quality"))


VECTORS = "e AS (SELECT label, vec_id AS item, embedding::DOUBLE[] AS v, CAST(vec_id * 37 % 101 AS DOUBLE) AS quality FROM embeddings)"


@query(f"""WITH RECURSIVE {VECTORS}, u AS (SELECT label, item, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u) GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT label, item, v FROM u JOIN c USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(v, c), 9) DESC, item) = 1),
g AS (SELECT f.label, f.item, list({{'item': u.item, 'v': u.v, 'far': CASE WHEN u.item = f.item THEN -1.0 ELSE 1 - list_dot_product(u.v, f.v) END}} ORDER BY u.item) AS items FROM f JOIN u ON u.label = f.label GROUP BY 1, 2),
st AS (SELECT label, item, 0 :: BIGINT AS pick, items FROM g
  UNION ALL SELECT label, nx.item, pick + 1, list_transform(items, lambda x: {{'item': x.item, 'v': x.v, 'far': CASE WHEN x.item = nx.item OR x.far < 0 THEN -1.0 ELSE least(x.far, 1 - list_dot_product(x.v, nx.v)) END}})
  FROM (SELECT *, list_filter(items, lambda x: round(x.far, 9) = list_max(list_transform(items, lambda y: round(y.far, 9))))[1] AS nx FROM st WHERE pick < 7) WHERE nx.far >= 0.2)
SELECT label, item, pick FROM st""")
def farthest_point_sampling(spark, d):
    """Key frames of each group."""
    return K.farthest_points(_items(spark, d), ["label"], 8, 0.2)


@query(f"""WITH RECURSIVE {VECTORS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY quality DESC, item) AS k FROM e),
st AS (SELECT label, k, item, [v] AS kept, true AS ok FROM o WHERE k = 1
  UNION ALL SELECT label, k, item, CASE WHEN ok THEN list_append(kept, v) ELSE kept END, ok FROM (
    SELECT o.label, o.k, o.item, o.v, s.kept, len(s.kept) < 5 AND len(list_filter(s.kept, lambda x: 1 - list_cosine_similarity(x, o.v) < 0.75)) = 0 AS ok FROM st s JOIN o ON o.label = s.label AND o.k = s.k + 1))
SELECT label, item FROM st WHERE ok""")
def non_redundant_selection(spark, d):
    """Exemplars of each entity that keep a distance."""
    return K.non_redundant(_items(spark, d), ["label"], 5, 0.75)


@query(f"""WITH RECURSIVE {linked_sql(0.25)} SELECT label, item, cluster FROM cl""")
def agglomerative_clusters(spark, d):
    """Complete-link clusters of each kind."""
    return K.link_clusters(_items(spark, d), ["label"], 0.25)


@query()
def running_centroid_clusters(spark, d):
    """Clusters opened in order of arrival."""
    return K.running_clusters(_items(spark, d), ["label"], 0.3)


@query(f"""WITH RECURSIVE {VECTORS}, b AS (SELECT *, CASE WHEN item % 3 = 0 THEN 'unknown' ELSE 'side' || item % 2 END AS side, CASE WHEN label % 2 = 0 THEN '' ELSE 'light' || item % 7 END AS light FROM e),
w AS (SELECT *, row_number() OVER (PARTITION BY label, side, light ORDER BY quality DESC, item) = 1 AS won, CASE WHEN side = 'unknown' THEN 0 ELSE 1 END + CASE WHEN light = '' THEN 0 ELSE 1 END AS known FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY won DESC, CASE WHEN won THEN known ELSE 0 END DESC, quality DESC, item) AS k FROM w),
st AS (SELECT label, k, item, [v] AS kept, true AS ok FROM o WHERE k = 1
  UNION ALL SELECT label, k, item, CASE WHEN ok THEN list_append(kept, v) ELSE kept END, ok FROM (
    SELECT o.label, o.k, o.item, o.v, s.kept, len(s.kept) < 6 AND (o.won OR len(list_filter(s.kept, lambda x: 1 - list_cosine_similarity(x, o.v) < 0.8)) = 0) AS ok FROM st s JOIN o ON o.label = s.label AND o.k = s.k + 1))
SELECT label, item FROM st WHERE ok""")
def attribute_diverse_selection(spark, d):
    """Exemplars of distinct attributes, filled up by distance."""
    i = F.col("item")
    side = F.when(i % 3 == 0, "unknown").otherwise(F.concat(F.lit("side"), (i % 2).cast("string")))
    light = F.when(F.col("label") % 2 == 0, "").otherwise(F.concat(F.lit("light"), (i % 7).cast("string")))
    return K.attribute_diverse(_items(spark, d).withColumns({"side": side, "light": light}), ["label"], ["side", "light"], 6, 0.8)


@query(f"""WITH RECURSIVE {VECTORS}, u AS (SELECT label, item, quality, item % 11 <> 0 AS h, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
f AS (SELECT label, item, v, h FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY quality DESC, item) = 1),
g AS (SELECT f.label, f.item, list({{'item': u.item, 'v': u.v, 'h': u.h, 'far': CASE WHEN u.item = f.item THEN -9.0 WHEN NOT u.h OR NOT f.h THEN NULL ELSE 1 - list_dot_product(u.v, f.v) END}} ORDER BY u.quality DESC, u.item) AS items FROM f JOIN u ON u.label = f.label GROUP BY 1, 2),
st AS (SELECT label, item, 0 :: BIGINT AS pick, items FROM g
  UNION ALL SELECT label, nx.item, pick + 1, list_transform(items, lambda x: {{'item': x.item, 'v': x.v, 'h': x.h, 'far': CASE WHEN x.item = nx.item OR x.far = -9.0 THEN -9.0 WHEN NOT x.h OR NOT nx.h THEN x.far ELSE least(coalesce(x.far, 9.0), 1 - list_dot_product(x.v, nx.v)) END}})
  FROM (SELECT *, list_filter(items, lambda x: coalesce(round(x.far, 9), -1.0) = list_max(list_transform(items, lambda y: coalesce(round(y.far, 9), -1.0))))[1] AS nx FROM st WHERE pick < 5))
SELECT label, item, pick FROM st""")
def max_min_selection(spark, d):
    """A subset that spreads: the best item, then the farthest ones."""
    items = _items(spark, d).withColumn("vec", F.when(F.col("item") % 11 != 0, F.col("vec")))
    return K.max_min_subset(items, ["label"], 6)


@query(f"""WITH RECURSIVE {VECTORS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY item) AS k FROM e),
st AS (SELECT label, k, item, [{{'item': item, 'v': v}}] AS kept, item AS into FROM o WHERE k = 1
  UNION ALL SELECT label, k, item, CASE WHEN near IS NULL THEN list_append(kept, {{'item': item, 'v': v}}) ELSE kept END, coalesce(near, item) FROM (
    SELECT o.label, o.k, o.item, o.v, s.kept, list_filter(s.kept, lambda x: round(list_cosine_similarity(x.v, o.v), 9) >= 0.3)[1].item AS near FROM st s JOIN o ON o.label = s.label AND o.k = s.k + 1))
SELECT label, item, "into" FROM st""")
def semantic_dedup(spark, d):
    """Items absorbed by an earlier similar one."""
    return K.absorb_similar(_items(spark, d), ["label"], 0.3)


def _boxes(spark, d):
    """One box an item: the least of those that share its number."""
    box = F.array(F.col("l_partkey") % 300, F.col("l_suppkey") % 300, F.col("l_partkey") % 300 + 100 + F.col("l_quantity").cast("long"), F.col("l_suppkey") % 300 + 150)
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("shot"), F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
        F.struct(box.alias("box"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("phrase")).alias("b"),
    )
    return rows.groupBy("shot", "frame", "item").agg(F.min("b").alias("b")).select("shot", "frame", "item", "b.box", "b.score", "b.phrase")


BOXES_SQL = """bx AS (SELECT l_orderkey AS frame, l_orderkey * 10 + l_linenumber AS item, [l_partkey % 300, l_suppkey % 300, l_partkey % 300 + 100 + CAST(l_quantity AS BIGINT), l_suppkey % 300 + 150] AS box, l_extendedprice AS score FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_orderkey * 10 + l_linenumber ORDER BY l_partkey % 300, l_suppkey % 300, l_quantity, l_extendedprice, l_returnflag) = 1)"""


@query(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, item) AS k FROM bx),
st AS (SELECT frame, 1 :: BIGINT AS k, [box] AS kept, item, score, true AS ok FROM o WHERE k = 1
  UNION ALL SELECT frame, k, CASE WHEN ok THEN list_append(kept, box) ELSE kept END, item, score, ok FROM (
    SELECT o.frame, o.k, s.kept, o.box, o.item, o.score, len(list_filter(s.kept, lambda b: greatest(0, least(b[3], o.box[3]) - greatest(b[1], o.box[1])) * greatest(0, least(b[4], o.box[4]) - greatest(b[2], o.box[2])) >=
      0.3 * ((b[3] - b[1]) * (b[4] - b[2]) + (o.box[3] - o.box[1]) * (o.box[4] - o.box[2]) - greatest(0, least(b[3], o.box[3]) - greatest(b[1], o.box[1])) * greatest(0, least(b[4], o.box[4]) - greatest(b[2], o.box[2]))))) = 0 AS ok
    FROM st s JOIN o ON o.frame = s.frame AND o.k = s.k + 1))
SELECT frame, item, score FROM st WHERE ok""")
def box_suppression(spark, d):
    """Non-maximum suppression by frame."""
    return K.suppress_boxes(_boxes(spark, d), ["frame"], 0.3)


@query()
def tracklets(spark, d):
    """Detections linked to tracks by shot."""
    b = _boxes(spark, d).withColumn("frame", F.dense_rank().over(Window.partitionBy("shot").orderBy("frame")))
    return K.track_boxes(b, ["shot"], 0.3, 3)


@query(f"""WITH RECURSIVE {TIMELINE}, t AS (SELECT story, idx, CAST(floor(value) AS BIGINT) % 90 + 1 + CASE WHEN event_id % 19 = 0 THEN 200 ELSE 0 END AS n FROM tl),
e AS (SELECT story, idx, n, sum(n) OVER (PARTITION BY story ORDER BY idx) AS hi FROM t), sp AS (SELECT story, CAST(hi - n AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, n, CAST(ceil(n / 150.0) AS BIGINT) AS parts FROM e),
pc AS (SELECT story, lo + p * CAST(ceil(n / CAST(parts AS DOUBLE)) AS BIGINT) AS lo, least(lo + (p + 1) * CAST(ceil(n / CAST(parts AS DOUBLE)) AS BIGINT), hi) AS hi, parts > 1 AS solid FROM (SELECT *, unnest(range(parts)) AS p FROM sp)),
it AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY lo) AS k FROM pc WHERE hi > lo),
f AS (SELECT story, k, 1 :: BIGINT AS g, lo AS glo, hi AS ghi, NOT solid AND hi - lo < 60 AS more FROM it WHERE k = 1
  UNION ALL SELECT i.story, i.k, CASE WHEN j THEN s.g ELSE s.g + 1 END, CASE WHEN j THEN s.glo ELSE i.lo END, i.hi, NOT i.solid AND i.hi - CASE WHEN j THEN s.glo ELSE i.lo END < 60
  FROM f s JOIN LATERAL (SELECT *, s.more AND NOT solid AND lo = s.ghi AND hi - s.glo <= 150 AS j FROM it) i ON i.story = s.story AND i.k = s.k + 1),
raw AS (SELECT story, g AS k, min(glo) AS lo, max(ghi) AS hi FROM f GROUP BY 1, 2),
m AS (SELECT story, k, 1 :: BIGINT AS c, lo AS mlo, hi AS mhi FROM raw WHERE k = 1
  UNION ALL SELECT r.story, r.k, CASE WHEN j THEN s.c ELSE s.c + 1 END, CASE WHEN j THEN s.mlo ELSE r.lo END, r.hi
  FROM m s JOIN LATERAL (SELECT *, lo = s.mhi AND (s.mhi - s.mlo < 60 OR hi - lo < 60) AND hi - s.mlo <= 150 AS j FROM raw) r ON r.story = s.story AND r.k = s.k + 1)
SELECT story, c - 1 AS chunk_id, min(mlo) AS lo, max(mhi) - 1 AS hi FROM m GROUP BY story, c""")
def packed_shots(spark, d):
    """Contiguous shots packed into chunks."""
    long = F.when(F.col("event_id") % 19 == 0, 200).otherwise(0)
    t = timeline(spark, d).select("story", "idx", (F.floor("value").cast("long") % 90 + 1 + long).alias("n"))
    end = F.sum("n").over(Window.partitionBy("story").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return K.pack_spans(t.withColumn("hi", end - 1).withColumn("lo", end - F.col("n")), ["story"], 60, 150)
