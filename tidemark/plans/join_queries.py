"""As-of, range, overlap, anti and keyed joins and set operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as J

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


@query(f"""WITH {TIMELINE}, l AS (SELECT story, sec AS at, event_id FROM tl WHERE eid = 'purchase'), r AS (SELECT story, sec AS at, event_id AS rep FROM tl WHERE eid = 'view')
SELECT l.story, l.at, l.event_id, (SELECT max(r.rep) FROM r WHERE r.story = l.story AND r.at = (SELECT max(x.at) FROM r x WHERE x.story = l.story AND x.at <= l.at)) AS rep FROM l""")
def as_of_join(spark, d):
    """The latest representation at or before each request."""
    t = timeline(spark, d)
    left = t.where("eid = 'purchase'").select("story", F.col("sec").alias("at"), "event_id")
    right = t.where("eid = 'view'").select("story", F.col("sec").alias("at"), F.col("event_id").alias("rep"))
    return J.as_of(left, right, ["story"], "at", "rep")


@query(f"""WITH {TIMELINE}, l AS (SELECT story, sec AS at, event_id FROM tl WHERE eid = 'error'), r AS (SELECT story, sec AS at, event_id AS rep FROM tl WHERE eid = 'click')
SELECT l.story, l.at, l.event_id, (SELECT max(r.rep) FROM r WHERE r.story = l.story AND r.at = (SELECT max(x.at) FROM r x WHERE x.story = l.story AND x.at <= l.at)) AS rep FROM l""")
def salted_as_of_join(spark, d):
    """The as-of join with each story's time cut into parts of three days."""
    t = timeline(spark, d)
    left = t.where("eid = 'error'").select("story", F.col("sec").alias("at"), "event_id")
    right = t.where("eid = 'click'").select("story", F.col("sec").alias("at"), F.col("event_id").alias("rep"))
    return J.salted_as_of(left, right, ["story"], "at", "rep", 3 * 86400)


@query(f"""WITH {TIMELINE}, x AS (SELECT story, eid, idx // 4 AS slot, idx AS rep FROM tl WHERE value > 15),
m AS (SELECT story, eid, slot, max(rep) AS rep FROM x GROUP BY ALL), s AS (SELECT DISTINCT story, eid, idx // 4 AS slot FROM tl),
e AS (SELECT s.*, m.rep AS exact, (SELECT max_by(y.rep, y.slot) FROM m y WHERE y.story = s.story AND y.eid = s.eid AND y.slot <= s.slot) AS prev
  FROM s LEFT JOIN m ON s.story = m.story AND s.eid = m.eid AND s.slot = m.slot)
SELECT story, eid, slot, coalesce(exact, prev) AS rep, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN prev IS NOT NULL THEN 'earlier' ELSE 'none' END AS source FROM e""")
def slot_expansion(spark, d):
    """Every present slot with its own crop, else the latest earlier one, else none."""
    t = timeline(spark, d).withColumn("slot", F.floor(F.col("idx") / 4))
    slots = t.select("story", "eid", "slot").distinct()
    exact = t.where("value > 15").select("story", "eid", "slot", F.col("idx").alias("rep"))
    return J.slot_fill(slots, exact, ["story", "eid"], "slot", "rep")


@query(f"""WITH {TIMELINE}, g AS (SELECT story, eid AS item, min(idx) AS at FROM tl WHERE value > 60 GROUP BY ALL),
f AS (SELECT g.story, g.item, g.at, t.event_id FROM g JOIN tl t ON t.story = g.story AND t.idx = g.at)
SELECT t.story, t.idx AS chunk_id, f.item, f.event_id AS reason FROM tl t JOIN f ON t.story = f.story AND f.at < t.idx""")
def forbidden_table(spark, d):
    """What earlier events have deprecated at each chunk."""
    t = timeline(spark, d)
    events = t.where("value > 60").select("story", F.col("eid").alias("item"), F.col("idx").alias("at"), "event_id")
    return J.deprecated_before(t.select("story", F.col("idx").alias("chunk_id")), events)


SPANS = """a AS (SELECT o_custkey AS story, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a_lo, epoch(o_orderdate)::BIGINT // 86400 + o_orderkey % 60 AS a_hi FROM orders),
b AS (SELECT o_custkey AS story, o_orderkey AS other, epoch(o_orderdate)::BIGINT // 86400 + 30 AS b_lo, epoch(o_orderdate)::BIGINT // 86400 + 30 + o_orderkey % 40 AS b_hi FROM orders WHERE o_orderstatus = 'F')"""


def spans(spark, d):
    o = table(spark, d, "orders")
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    a = o.select(F.col("o_custkey").alias("story"), "o_orderkey", day.alias("a_lo"), (day + F.col("o_orderkey") % 60).alias("a_hi"))
    b = o.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("story"), F.col("o_orderkey").alias("other"), (day + 30).alias("b_lo"), (day + 30 + F.col("o_orderkey") % 40).alias("b_hi")
    )
    return a, b


@query(f"""WITH {SPANS} SELECT a.story, o_orderkey, other, least(a_hi, b_hi) - greatest(a_lo, b_lo) + 1 AS days FROM a JOIN b ON a.story = b.story AND a_lo <= b_hi AND b_lo <= a_hi""")
def presence_overlap(spark, d):
    """Spans of a story that overlap spans of another table, by buckets."""
    a, b = spans(spark, d)
    return J.overlaps(a, b, ["story"], 64).select(
        "story", "o_orderkey", "other", (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo") + 1).alias("days")
    )


@query(f"""WITH {SPANS} SELECT story, o_orderkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.story = a.story AND b_lo <= a_lo AND b_hi >= a_hi)""")
def uncovered_spans(spark, d):
    """Spans that no excluded span contains."""
    a, b = spans(spark, d)
    out = J.uncovered(a.withColumnsRenamed({"a_lo": "lo", "a_hi": "hi"}), b.withColumnsRenamed({"b_lo": "lo", "b_hi": "hi"}), ["story"], "lo", "hi", 64)
    return out.select("story", "o_orderkey")


@query(f"""WITH {PRESENCE}, r AS (SELECT DISTINCT kind, eid FROM pr)
SELECT p.story, p.idx, p.kind, p.eid, r.eid AS absent FROM pr p JOIN r ON p.kind = r.kind AND p.eid != r.eid
WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.story = p.story AND q.idx = p.idx AND q.eid = r.eid)""")
def negative_controls(spark, d):
    """Pairs of a present and an absent entity of one kind."""
    p = presence(spark, d)
    return J.control_pairs(p.drop("kind"), p.select("kind", "eid").distinct())


@query("""WITH i AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), e AS (
  SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'replace' ELSE 'keep' END AS action, 'new' AS v FROM customer WHERE c_acctbal > 4000
  UNION ALL SELECT -c_custkey - 1, 'add', 'added' FROM customer WHERE c_acctbal < 0)
SELECT coalesce(i.k, e.k) AS k, CASE WHEN action IN ('replace', 'add') THEN e.v ELSE i.v END AS v FROM i FULL JOIN e ON i.k = e.k WHERE coalesce(action, 'keep') != 'reject'""")
def patch_apply(spark, d):
    """Keep, reject, replace and add by key."""
    c = table(spark, d, "customer")
    items = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    action = F.when(F.col("c_custkey") % 3 == 0, "reject").when(F.col("c_custkey") % 3 == 1, "replace").otherwise("keep")
    edits = c.where("c_acctbal > 4000").select(F.col("c_custkey").alias("k"), action.alias("action"), F.lit("new").alias("v"))
    added = c.where("c_acctbal < 0").select((-F.col("c_custkey") - 1).alias("k"), F.lit("add").alias("action"), F.lit("added").alias("v"))
    return J.keyed_edits(items, edits.unionByName(added), "k", "v")


@query("""SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY conv_id, text""")
def usable_references(spark, d):
    """The first occurrence of each path in rank order."""
    c = table(spark, d, "conversations")
    return J.first_by_rank(c.select("conv_id", "text", "turn"), ["conv_id"], "text", "turn")


@query("""SELECT o_orderkey, coalesce(a.v, b.v, c.v) AS v FROM (SELECT o_orderkey, o_custkey % 50 AS k1, o_custkey % 20 AS k2, o_custkey % 10 AS k3 FROM orders) o
LEFT JOIN (SELECT s_suppkey AS k1, 'path' AS v FROM supplier WHERE s_acctbal > 1000) a USING (k1)
LEFT JOIN (SELECT n_nationkey AS k2, n_name AS v FROM nation WHERE n_regionkey < 3) b USING (k2)
LEFT JOIN (SELECT r_regionkey AS k3, r_name AS v FROM region) c USING (k3)""")
def decision_propagation(spark, d):
    """A decision taken over from the first of three keys that has one."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k1"), (F.col("o_custkey") % 20).alias("k2"), (F.col("o_custkey") % 10).alias("k3"))
    a = table(spark, d, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("k1"), F.lit("path").alias("v"))
    b = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("v"))
    c = table(spark, d, "region").select(F.col("r_regionkey").alias("k3"), F.col("r_name").alias("v"))
    return J.prioritised(o, [(a, "k1"), (b, "k2"), (c, "k3")], "v").select("o_orderkey", "v")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderstatus != 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS v FROM orders WHERE o_totalprice > 100000)
SELECT count(*) AS n, round(avg(CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 1.0 ELSE 0.0 END), 4) AS agreement FROM a JOIN b USING (k)""")
def retest_agreement(spark, d):
    """Agreement of two passes over the units both have."""
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    b = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("v"))
    return J.agreement(a, b, "k", "v")


@query(f"""WITH {TIMELINE} SELECT story, idx, eid, lag(idx) OVER (PARTITION BY story, eid ORDER BY idx) AS prev_idx, lag(value) OVER (PARTITION BY story, eid ORDER BY idx) AS prev_value FROM tl""")
def previous_appearance(spark, d):
    """The latest earlier segment that lists the entity."""
    from pyspark.sql import Window

    own = Window.partitionBy("story", "eid").orderBy("idx")
    return timeline(spark, d).select("story", "idx", "eid", F.lag("idx").over(own).alias("prev_idx"), F.lag("value").over(own).alias("prev_value"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orphans(spark, d):
    """Ids that no row refers to."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL""")
def metadata_lookup(spark, d):
    """Facts with entity metadata from small roster tables."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    )


ROSTER = """x AS (SELECT l_orderkey AS seg, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT l_linestatus || CAST(l_linenumber % 2 AS VARCHAR))) AS b,
  list_sort(list(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'F1' END)) AS c FROM lineitem GROUP BY 1)"""


@query(f"""WITH {ROSTER} SELECT seg, array_to_string(list_sort(list_distinct(list_concat(list_concat(a, b), list_filter(c, lambda v: NOT list_contains(a, v))))), ',') AS roster,
  array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(c, v))), ',') AS missing, len(list_intersect(b, c)) AS covered FROM x""")
def blinded_roster(spark, d):
    """Union, difference and intersection of the id sets of a segment."""
    li = table(spark, d, "lineitem")
    x = li.groupBy(F.col("l_orderkey").alias("seg")).agg(
        F.collect_set("l_returnflag").alias("a"), F.collect_set(F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string"))).alias("b"),
        F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("F1")).alias("c"),
    )
    roster = F.array_union(F.array_union("a", "b"), F.array_except("c", "a"))
    return x.select(
        "seg", F.array_join(F.array_sort(roster), ",").alias("roster"), F.array_join(F.array_sort(F.array_except("b", "c")), ",").alias("missing"),
        F.size(F.array_intersect("b", "c")).cast("long").alias("covered"),
    )


@query("""SELECT DISTINCT l_suppkey AS system FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.09 EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.095""")
def vanished_systems(spark, d):
    """Ids of an earlier run that a later one lacks."""
    li = table(spark, d, "lineitem")
    old = li.where("l_returnflag = 'A' and l_discount > 0.09").select(F.col("l_suppkey").alias("system"))
    new = li.where("l_returnflag = 'N' and l_discount > 0.095").select(F.col("l_suppkey").alias("system"))
    return old.subtract(new)


@query("""WITH r AS (SELECT lower(trim(p_name)) AS name, p_type AS kind, min(p_partkey) AS first_key, min_by(p_brand, p_partkey) AS brand, count(*) AS n, max(p_size) AS size FROM part GROUP BY 1, 2)
SELECT * FROM r""")
def merged_roster(spark, d):
    """Entries of one normalised name and kind merged; the first one's fields win."""
    p = table(spark, d, "part")
    return p.groupBy(F.lower(F.trim("p_name")).alias("name"), F.col("p_type").alias("kind")).agg(
        F.min("p_partkey").alias("first_key"), F.min_by("p_brand", "p_partkey").alias("brand"), F.count(F.lit(1)).alias("n"), F.max("p_size").alias("size")
    )


@query("""SELECT DISTINCT l_suppkey % 10 AS cond, l_orderkey % 50 AS story, l_linenumber AS seg FROM lineitem UNION SELECT DISTINCT o_custkey % 10, o_orderkey % 50, 0 FROM orders""")
def job_set(spark, d):
    """Distinct jobs of two sources."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = li.select((F.col("l_suppkey") % 10).alias("cond"), (F.col("l_orderkey") % 50).alias("story"), F.col("l_linenumber").alias("seg"))
    b = o.select((F.col("o_custkey") % 10).alias("cond"), (F.col("o_orderkey") % 50).alias("story"), F.lit(0).alias("seg"))
    return a.unionByName(b).distinct()
