"""Votes, rates, boards, calibration and resampling with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import f1, ratio, weighted_mean, wilson
from tidemark.operators import scoring as S

from .bindings import FACTS, GAPS, TIMELINE, facts, table, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


VOTES = """v AS (SELECT o_custkey AS unit, o_orderpriority AS vote0, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS call FROM orders),
vv AS (SELECT unit, call, coalesce(CASE WHEN vote0 = '5-LOW' THEN NULL WHEN vote0 < '3' THEN 'true' ELSE 'false' END, 'abstain') AS vote FROM v)"""


def votes(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    call = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    vote = F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderpriority") < "3", "true").otherwise("false")
    return o.select(F.col("o_custkey").alias("unit"), call.alias("call"), vote.alias("vote"))


@query(f"""WITH {VOTES}, c AS (SELECT unit, vote, count(*) AS n, min(call) AS first_call FROM vv GROUP BY unit, vote),
r AS (SELECT *, sum(n) OVER (PARTITION BY unit) AS calls, row_number() OVER (PARTITION BY unit ORDER BY n DESC, first_call) AS k FROM c)
SELECT unit, vote, round(CAST(n AS DOUBLE) / calls, 4) AS agreement FROM r WHERE k = 1""")
def majority_vote(spark, d):
    """Majority of the calls; abstentions count, ties go to the vote cast first."""
    return S.majority_vote(votes(spark, d), ["unit"])


@query(f"""WITH {TIMELINE}, {GAPS}, {FACTS}
SELECT kind, round(CAST(count(*) FILTER (hit) AS DOUBLE) / nullif(count(*) FILTER (hit IS NOT NULL), 0), 4) AS all_rate,
  round(CAST(count(*) FILTER (hit AND op = 'recall') AS DOUBLE) / nullif(count(*) FILTER (hit IS NOT NULL AND op = 'recall'), 0), 4) AS continuity_rate,
  round(CAST(count(*) FILTER (hit AND gap >= 30) AS DOUBLE) / nullif(count(*) FILTER (hit IS NOT NULL AND gap >= 30), 0), 4) AS long_gap_rate
FROM fx GROUP BY kind""")
def pooled_capabilities(spark, d):
    """Micro-averaged capability rates of each kind."""
    tallies = S.capability_tally(facts(spark, d), ["story", "kind"])
    return S.pooled_rates(tallies, ["kind"], ["all", "continuity", "long_gap"])


@query(f"""WITH {TIMELINE}, {GAPS}, {FACTS}, c AS (SELECT eid, CAST(count(*) FILTER (hit) AS DOUBLE) AS k, CAST(count(*) FILTER (hit IS NOT NULL) AS DOUBLE) AS n FROM fx GROUP BY eid),
w AS (SELECT eid, k / n AS p, n, 1 + 1.96 * 1.96 / n AS base FROM c)
SELECT eid, round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n)) / base - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / base), 4) AS low,
  round(least(1.0, (p + 1.96 * 1.96 / (2 * n)) / base + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / base), 4) AS high FROM w""")
def wilson_intervals(spark, d):
    """95 % intervals of recall."""
    t = facts(spark, d).groupBy("eid").agg(F.count_if(F.col("hit")).alias("k"), F.count_if(F.col("hit").isNotNull()).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return t.select("eid", low.alias("low"), high.alias("high"))


COVER = """e AS (SELECT o_orderkey AS segment, [o_orderpriority, o_orderstatus] AS entities FROM orders),
r AS (SELECT l_orderkey AS segment, l_linenumber AS ref, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'F' WHEN l_returnflag = 'R' THEN '5-LOW' ELSE 'O' END AS entity FROM lineitem),
p AS (SELECT segment, ref, count(entity) AS n_entities FROM r GROUP BY segment, ref),
h AS (SELECT segment, count(*) AS n_refs, count(*) FILTER (n_entities > 0) AS n_useful FROM p GROUP BY segment),
s AS (SELECT segment, list(DISTINCT entity) FILTER (entity IS NOT NULL) AS seen FROM r GROUP BY segment),
j AS (SELECT e.segment, coalesce(n_refs, 0) AS n_refs, CASE WHEN n_refs > 0 THEN round(CAST(n_useful AS DOUBLE) / n_refs, 4) END AS p,
  round(len(list_intersect(list_distinct(entities), coalesce(seen, []))) / CAST(len(list_distinct(entities)) AS DOUBLE), 4) AS r
  FROM e LEFT JOIN h USING (segment) LEFT JOIN s USING (segment))"""


def cover_inputs(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    expected = o.select(F.col("o_orderkey").alias("segment"), F.array("o_orderpriority", "o_orderstatus").alias("entities"))
    entity = F.when(F.col("l_linenumber") % 4 == 0, None).when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "R", "5-LOW").otherwise("O")
    refs = li.select(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("ref"), entity.alias("entity"))
    return refs, expected


@query(f"""WITH {COVER} SELECT segment, n_refs, p AS precision, r AS recall,
  CASE WHEN p + r = 0 THEN 0.0 ELSE round(2 * p * r / nullif(p + r, 0), 4) END AS f1 FROM j""")
def coverage_f1(spark, d):
    """Precision, recall and F1 of the references chosen for each segment."""
    return S.coverage_scores(*cover_inputs(spark, d))


@query("""SELECT l_suppkey AS system, l_returnflag AS dataset, count(*) AS n, round(sum(l_discount * coalesce(nullif(l_quantity, 0), 1.0)) / sum(coalesce(nullif(l_quantity, 0), 1.0)), 6) AS weighted,
  round(avg(l_discount), 6) AS plain FROM lineitem GROUP BY ALL""")
def weighted_means(spark, d):
    """Duration-weighted means; a null or zero weight counts as one."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("system"), F.col("l_returnflag").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), F.round(weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("weighted"),
        F.round(F.avg("l_discount"), 6).alias("plain"),
    )


@query("""SELECT system, dataset, count(*) AS n_samples, count(score) AS n_scored, round(avg(score), 6) AS mean_score
FROM (SELECT l_suppkey AS system, l_returnflag AS dataset, CASE WHEN l_linenumber != 7 THEN l_discount END AS score FROM lineitem)
GROUP BY GROUPING SETS ((system, dataset), (system))""")
def macro_leaderboard(spark, d):
    """Macro averages of each system, in all and by dataset."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("system"), F.col("l_returnflag").alias("dataset"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("score"),
    )
    return S.macro_board(li, "system", "dataset", "score")


@query("""WITH m AS (SELECT l_suppkey AS system, count(DISTINCT l_returnflag) AS n_sets, round(avg(CASE WHEN l_suppkey % 10 != 0 THEN l_discount END), 6) AS f1 FROM lineitem GROUP BY 1)
SELECT system, n_sets, f1, CAST(row_number() OVER (ORDER BY f1 DESC NULLS LAST, system) AS INT) AS place FROM m""")
def leaderboard_order(spark, d):
    """Systems by score, those without one last."""
    from pyspark.sql import Window

    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("system")).agg(
        F.countDistinct("l_returnflag").alias("n_sets"),
        F.round(F.avg(F.when(F.col("l_suppkey") % 10 != 0, F.col("l_discount"))), 6).alias("f1"),
    )
    # One row a system: the board is small by its nature.
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("f1"), "system")))


@query(f"""WITH {TIMELINE}, {GAPS}, u AS (SELECT story, eid, kind, CASE WHEN gap <= 0 THEN '0' WHEN gap <= 4 THEN '1-4' WHEN gap <= 29 THEN '5-29' ELSE '>=30' END AS gap_bin,
  CASE WHEN gap = 0 THEN 'gap0' ELSE 'main' END AS stratum, value FROM gp WHERE gap IS NOT NULL),
c AS (SELECT unnest(list_filter([stratum || '|all', stratum || '|' || kind || '|' || gap_bin, stratum || '|' || kind, CASE WHEN stratum = 'main' THEN 'main|all|' || gap_bin END], lambda x: x IS NOT NULL)) AS cell, value FROM u)
SELECT cell, count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS share FROM c GROUP BY cell""")
def roll_up_cells(spark, d):
    """Units counted in each of their cells."""
    from tidemark.functions.stats import gap_bin
    from tidemark.operators.timeline import gaps

    u = gaps(timeline(spark, d)).where("gap is not null").withColumn("gap_bin", gap_bin(F.col("gap")))
    u = u.withColumn("stratum", F.when(F.col("gap") == 0, "gap0").otherwise("main"))
    return S.roll_up_cells(u).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6).alias("share")
    )


SCORED = "s AS (SELECT lang, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id))"


def scored(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(labels, "doc_id").select(
        "lang", "score", (F.col("quality") == 1).alias("pos")
    )


@query(f"""WITH {SCORED}, g AS (SELECT lang, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY lang, score),
w AS (SELECT lang, p, n, p * (sum(n) OVER (PARTITION BY lang ORDER BY score) - n + n / 2.0) AS wins FROM g)
SELECT lang, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(wins) / nullif(sum(p) * sum(n), 0), 4) AS auc FROM w GROUP BY lang""")
def roc_auc(spark, d):
    """Area under the ROC curve by rank sums."""
    return S.auc(scored(spark, d), ["lang"], "score", "pos")


@query(f"""WITH {SCORED}, g AS (SELECT lang, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY lang, score),
w AS (SELECT lang, score, sum(p) OVER u AS tp, sum(n) OVER u AS fp, sum(p) OVER a AS np, sum(n) OVER a AS nn FROM g WINDOW u AS (PARTITION BY lang ORDER BY score DESC), a AS (PARTITION BY lang))
SELECT lang, score AS threshold, round(CAST(tp AS DOUBLE) / nullif(np, 0) - CAST(fp AS DOUBLE) / nullif(nn, 0), 4) AS j
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tp * nn - fp * np DESC, score) AS k FROM w) WHERE k = 1""")
def youden_threshold(spark, d):
    """Threshold of largest sensitivity plus specificity; the lowest of equals."""
    return S.youden(scored(spark, d), ["lang"], "score", "pos")


@query("""WITH a AS (SELECT l_suppkey AS system, list_sort(list(l_extendedprice)) AS o FROM lineitem GROUP BY 1)
SELECT system, len(o) AS n, o[1 + CAST(floor(0.05 * (len(o) - 1)) AS INT)] AS q05, o[1 + CAST(floor(0.95 * (len(o) - 1)) AS INT)] AS q95, o[1 + CAST(floor(len(o) / 2) AS INT)] AS upper_median FROM a""")
def lower_quantiles(spark, d):
    """Quantiles at floor indices and the upper median, by system."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("system"), "l_extendedprice")
    at = lambda share: F.floor(F.lit(share) * (F.col("n") - 1))
    return S.rank_quantiles(rows, ["system"], "l_extendedprice", {"q05": at(0.05), "q95": at(0.95), "upper_median": F.floor(F.col("n") / 2)})


@query("""WITH w AS (SELECT o_orderpriority AS reason, count(*) AS n, sum(1.0 / CASE o_orderstatus WHEN 'P' THEN 0.25 WHEN 'F' THEN 0.5 ELSE 1.0 END) AS w FROM orders GROUP BY 1)
SELECT reason, n, round(w / sum(w) OVER (), 6) AS share FROM w""")
def inverse_weighted_shares(spark, d):
    """Shares with rows weighted by the inverse of their inclusion probability."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("reason"),
        F.when(F.col("o_orderstatus") == "P", 0.25).when(F.col("o_orderstatus") == "F", 0.5).otherwise(1.0).alias("p"),
    )
    return S.inverse_weighted_shares(o, "reason", "p")


BOOT = """tal AS (SELECT user_id % 20 AS story, event_type AS grp, count(*) FILTER (value > 20) AS hit, count(*) AS n FROM events GROUP BY 1, 2),
dr AS (SELECT d AS draw, ((d * 7919 + s * 104729 + d * s * 31) % 20) AS story FROM range(0, 200) t(d), range(0, 20) u(s)),
dd AS (SELECT draw, story, count(*) AS times FROM dr GROUP BY 1, 2),
ra AS (SELECT draw, grp, CAST(sum(times * hit) AS DOUBLE) / sum(times * n) AS rate FROM dd JOIN tal USING (story) GROUP BY 1, 2),
o AS (SELECT grp, list_sort(list(rate)) AS o FROM ra GROUP BY grp)"""


def bootstrap_inputs(spark, d):
    e = table(spark, d, "events")
    tal = e.groupBy((F.col("user_id") % 20).alias("story"), F.col("event_type").alias("grp")).agg(
        F.count_if(F.col("value") > 20).alias("hit"), F.count(F.lit(1)).alias("n")
    )
    draws = spark.range(200).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("s"))
    story = (F.col("draw") * 7919 + F.col("s") * 104729 + F.col("draw") * F.col("s") * 31) % 20
    return tal, draws.select("draw", story.alias("story"))


@query(f"""WITH {BOOT} SELECT grp, len(o) AS n_draws, round(o[1 + CAST(floor(0.025 * len(o)) AS INT)], 6) AS low, round(o[1 + CAST(floor(0.975 * len(o)) AS INT) - 1], 6) AS high FROM o""")
def clustered_bootstrap(spark, d):
    """Percentile intervals over draws of whole stories; draws come from an arithmetic table."""
    out = S.bootstrap(*bootstrap_inputs(spark, d), "grp")
    return out.withColumn("n_draws", F.col("n_draws").cast("long"))


@query(f"""WITH {BOOT}, p AS (SELECT a.draw, a.rate - b.rate AS diff FROM ra a JOIN ra b ON a.draw = b.draw AND a.grp = 'view' AND b.grp = 'click'),
q AS (SELECT list_sort(list(diff)) AS o, avg(diff) AS m FROM p)
SELECT round(m, 6) AS mean_diff, round(o[1 + CAST(floor(0.025 * len(o)) AS INT)], 6) AS low, round(o[1 + CAST(floor(0.975 * len(o)) AS INT) - 1], 6) AS high FROM q""")
def paired_bootstrap(spark, d):
    """Interval of the difference of two systems' rates, paired by draw."""
    tal, draws = bootstrap_inputs(spark, d)
    times = draws.groupBy("draw", "story").agg(F.count(F.lit(1)).alias("times"))
    side = lambda g: F.sum(F.when(F.col("grp") == g, F.col("times") * F.col("hit"))) / F.sum(F.when(F.col("grp") == g, F.col("times") * F.col("n")))
    diff = times.join(tal, "story").groupBy("draw").agg((side("view") - side("click")).alias("diff"))
    o = diff.agg(F.array_sort(F.collect_list("diff")).alias("o"), F.avg("diff").alias("m"))
    at = lambda share, less: F.get("o", F.floor(share * F.size("o")).cast("int") - less)
    return o.select(F.round("m", 6).alias("mean_diff"), F.round(at(0.025, 0), 6).alias("low"), F.round(at(0.975, 1), 6).alias("high"))


@query("""WITH s AS (SELECT conv_id AS story, count(*) AS n FROM conversations GROUP BY 1)
SELECT story, n, CAST(sum(n) OVER w AS BIGINT) AS cum_segments, round(sum((n * 20 + 150) / 3600.0) OVER w, 6) AS cum_hours, max(n) OVER w AS longest
FROM s WINDOW w AS (ORDER BY n, story ROWS UNBOUNDED PRECEDING)""")
def capacity_plan(spark, d):
    """Running totals of a plan that takes short stories first."""
    s = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("story")).agg(F.count(F.lit(1)).alias("n"))
    return S.capacity_plan(s, ["n", "story"], "n", 20.0, 150.0)


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY 1, 2""")
def pricing_rollup(spark, d):
    """Conditional sums over the facts, with the filter pushed to the scan."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02 00:00:00").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"),
        F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )


@query("""WITH c AS (SELECT l_returnflag AS code, l_linestatus AS severity, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY ROLLUP (l_linestatus, l_returnflag))
SELECT coalesce(severity, 'all') AS severity, coalesce(code, 'all') AS code, n FROM c""")
def violation_summary(spark, d):
    """Findings by severity and code with subtotals."""
    li = table(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_linestatus").alias("severity"), F.col("l_returnflag").alias("code"))
    return li.rollup("severity", "code").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("severity", F.lit("all")).alias("severity"), F.coalesce("code", F.lit("all")).alias("code"), "n"
    )


@query(f"""WITH {COVER}, m AS (SELECT avg(p) AS p, avg(r) AS r, count(*) AS n, count(p) AS n_scored FROM j)
SELECT n, n_scored, round(p, 4) AS mean_precision, round(r, 4) AS mean_recall, round(2 * p * r / (p + r), 4) AS f1 FROM m""")
def coverage_summary(spark, d):
    """Corpus means of the coverage scores and their F1."""
    c = S.coverage_scores(*cover_inputs(spark, d)).agg(
        F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.count(F.lit(1)).alias("n"), F.count("precision").alias("n_scored")
    )
    return c.select("n", "n_scored", F.round("p", 4).alias("mean_precision"), F.round("r", 4).alias("mean_recall"), f1(F.col("p"), F.col("r")).alias("f1"))


@query("""SELECT label, count(*) AS n, round(CAST(count(*) FILTER (vec_id % 3 = 0) AS DOUBLE) / nullif(count(*) FILTER (vec_id % 5 != 0), 0), 4) AS rate FROM embeddings GROUP BY label""")
def identity_rates(spark, d):
    """Counters of verdicts turned into rates; null without a denominator."""
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("vec_id") % 3 == 0), F.count_if(F.col("vec_id") % 5 != 0)).alias("rate"))
