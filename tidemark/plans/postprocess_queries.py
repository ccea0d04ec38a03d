"""Checks of annotations: an order is a movie, its lineitems are entities and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import postprocess as P
from tidemark.sources import flatten

from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def annotations(spark, d):
    """movie, doc: JSON texts with repeated ids, missing names, odd times and wrong counts."""
    li = table(spark, d, "lineitem")
    # Lines meet as numbers and are written out by order, all entities or segments at once; a null field is left out of the text.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    g = li.groupBy(F.col("l_orderkey").alias("movie")).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def entity(x):
        p, q = x["l_partkey"], x["q"]
        return F.struct(
            F.when(p % 11 != 0, F.concat(F.lit("e"), (p % 5).cast("string"))).alias("char_id"), F.when(p % 7 != 0, "Name").otherwise(" ").alias("name"),
            F.when(p % 13 == 0, "soon").alias("first_presence_seconds"), F.when(p % 13 != 0, q).alias("first_presence_seconds"),
            (q + x["l_linenumber"] - 3).alias("last_presence_seconds"), F.array(F.struct((p % 60 - 1).alias("seconds"))).alias("state_changes"),
        )

    def segment(x):
        n, p, s = x["l_linenumber"], x["l_partkey"], x["l_suppkey"]
        return F.struct(
            F.concat(F.lit("s"), (s % 6).cast("string")).alias("segment_id"), (n * 5).cast("int").alias("start_seconds"), (n * 5 + s % 4 - 1).cast("int").alias("end_seconds"),
            F.when(s % 3 == 0, 2).otherwise(s % 4 - 1).cast("int").alias("duration_seconds"),
            F.array(F.concat(F.lit("e"), (p % 5).cast("string")), F.concat(F.lit("e"), (s % 5).cast("string"))).alias("present_entity_ids"),
        )

    g = g.select("movie", F.to_json(F.transform("lines", entity)).alias("e"), F.to_json(F.transform("lines", segment)).alias("s"), F.size("lines").alias("n"))
    head = F.when(F.col("movie") % 10 == 0, "").otherwise(F.format_string('"counts":{"characters":%d,"props":0,"locations":%d,"scenes":1},', "n", F.col("movie") % 2))
    low = F.format_string('"self_check":{"low_confidence_segment_ids":["s%d"]}', F.col("movie") % 8)
    props = F.when(F.col("movie") % 9 == 0, "").otherwise('"props":[],')
    body = F.concat(
        F.lit('{"video_duration_seconds":40,'), head, props, F.lit('"characters":'), F.col("e"), F.lit(',"locations":[],"screenplay":{"scenes":[{"scene_id":"a","visual_segments":'),
        F.col("s"), F.lit("}]},"), low, F.lit("}"),
    )
    return P.parsed(g.select("movie", F.when(F.col("movie") % 31 == 0, "[1]").otherwise(body).alias("text")))


ROWS = """r AS (SELECT l_orderkey AS movie, l_partkey AS p, l_suppkey AS s, CAST(trunc(l_quantity) AS BIGINT) AS q, l_linenumber AS n,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, CASE WHEN l_partkey % 11 <> 0 THEN 'e' || (l_partkey % 5) END AS eid FROM lineitem WHERE l_orderkey % 31 <> 0)"""
ENTITY_SQL = f"""WITH {ROWS}, e AS (SELECT *, '$.characters[' || pos || ']' AS path, CASE WHEN eid IS NOT NULL THEN row_number() OVER (PARTITION BY movie, eid ORDER BY pos) END AS k FROM r)
SELECT movie, 'MISSING_ENTITY_ID' AS code, path || '.char_id' AS path, 'error' AS severity FROM e WHERE eid IS NULL
UNION ALL SELECT movie, 'DUPLICATE_ENTITY_ID', path || '.char_id', 'error' FROM e WHERE k > 1
UNION ALL SELECT movie, 'EMPTY_ENTITY_NAME', path || '.name', 'error' FROM e WHERE eid IS NOT NULL AND p % 7 = 0
UNION ALL SELECT movie, 'INVALID_PRESENCE_TIME', path || '.first_presence_seconds', 'warning' FROM e WHERE eid IS NOT NULL AND p % 13 = 0
UNION ALL SELECT movie, 'PRESENCE_TIME_OUT_OF_RANGE', path, 'warning' FROM e WHERE eid IS NOT NULL AND p % 13 <> 0 AND n < 3
UNION ALL SELECT movie, 'PRESENCE_TIME_OUT_OF_RANGE', path || '.first_presence_seconds', 'warning' FROM e WHERE eid IS NOT NULL AND p % 13 <> 0 AND q > 40
UNION ALL SELECT movie, 'PRESENCE_TIME_OUT_OF_RANGE', path || '.last_presence_seconds', 'warning' FROM e WHERE eid IS NOT NULL AND p % 13 <> 0 AND (q + n - 3 > 40 OR q + n - 3 < 0)
UNION ALL SELECT movie, 'INVALID_STATE_EVENT_TIME', path || '.state_changes[0].seconds', 'warning' FROM e WHERE eid IS NOT NULL AND (p % 60 - 1 < 0 OR p % 60 - 1 > 40)"""


@query(ENTITY_SQL)
def entity_checks(spark, d):
    """Ids, names, presence times and state changes of annotated entities."""
    return P.entity_findings(annotations(spark, d))


@query(f"""WITH {ROWS}, e AS (SELECT *, '$.screenplay.scenes[0].visual_segments[' || pos || ']' AS path, row_number() OVER (PARTITION BY movie, s % 6 ORDER BY pos) AS k FROM r),
pr AS (SELECT movie, path, 'e' || (p % 5) AS eid, 0 AS j FROM e UNION ALL SELECT movie, path, 'e' || (s % 5), 1 FROM e),
kn AS (SELECT DISTINCT movie, eid FROM r WHERE eid IS NOT NULL), lo AS (SELECT DISTINCT movie, movie % 8 AS x FROM r)
SELECT movie, 'DUPLICATE_SEGMENT_ID' AS code, path || '.segment_id' AS path, 'error' AS severity FROM e WHERE k > 1
UNION ALL SELECT movie, 'INVALID_SEGMENT_TIME', path, 'error' FROM e WHERE s % 4 = 0
UNION ALL SELECT movie, 'SEGMENT_DURATION_MISMATCH', path || '.duration_seconds', 'error' FROM e WHERE s % 3 = 0 AND s % 4 <> 3
UNION ALL SELECT movie, 'DUPLICATE_PRESENT_ENTITY_ID', path || '.present_entity_ids', 'error' FROM e WHERE p % 5 = s % 5
UNION ALL SELECT movie, 'UNKNOWN_PRESENT_ENTITY_ID', path || '.present_entity_ids', 'error' FROM pr ANTI JOIN kn USING (movie, eid)
UNION ALL SELECT movie, 'UNKNOWN_SELF_CHECK_SEGMENT', '$.self_check.low_confidence_segment_ids', 'error' FROM lo ANTI JOIN (SELECT movie, s % 6 AS x FROM r) USING (movie, x)""")
def segment_checks(spark, d):
    """Times, ids and presence of annotated segments."""
    return P.segment_findings(annotations(spark, d))


@query("""WITH m AS (SELECT l_orderkey AS movie, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT * FROM m WHERE movie % 31 <> 0)
SELECT movie, 'INVALID_ROOT' AS code, '$' AS path, 'error' AS severity FROM m WHERE movie % 31 = 0
UNION ALL SELECT movie, 'INVALID_COLLECTION', '$.props', 'error' FROM s WHERE movie % 9 = 0
UNION ALL SELECT movie, 'MISSING_COUNTS', '$.counts', 'warning' FROM s WHERE movie % 10 = 0
UNION ALL SELECT movie, 'COUNT_MISMATCH', '$.counts.locations', 'warning' FROM s WHERE movie % 10 <> 0 AND movie % 2 = 1""")
def structural_lint(spark, d):
    """Collections, screenplay and declared counts of annotations."""
    return P.structure_findings(annotations(spark, d))


@query("""SELECT l_orderkey AS movie, CASE WHEN l_orderkey % 31 = 0 THEN 0 ELSE count(*) END AS n_characters, CASE WHEN l_orderkey % 31 = 0 THEN 0 ELSE count(*) END AS n_segments,
  CASE WHEN l_orderkey % 31 = 0 THEN '' ELSE array_to_string(list('e' || (l_partkey % 5) ORDER BY l_partkey % 5) FILTER (l_partkey % 11 <> 0), ',') END AS ids FROM lineitem GROUP BY 1""")
def normalized_annotations(spark, d):
    """Entities in the order of their ids, and true counts."""
    rows = P.normalized(annotations(spark, d))
    ids = F.filter(F.transform("characters", lambda v: P.string(P.field(v, "char_id"))), lambda x: x.isNotNull())
    joined = F.concat_ws(",", ids)
    n = lambda c: F.col(f"counts.{c}").cast("long")
    return rows.select("movie", n("characters").alias("n_characters"), n("visual_segments").alias("n_segments"), F.when(F.size(ids) > 0, joined).otherwise(F.when(n("characters") > 0, F.lit(None)).otherwise("")).alias("ids"))


@query("""WITH r AS (SELECT l_orderkey AS movie, l_linenumber * 5 AS a, l_linenumber * 5 + l_suppkey % 4 - 1 AS b, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem WHERE l_orderkey % 31 <> 0)
SELECT movie, CAST(row_number() OVER (PARTITION BY movie ORDER BY least(a, b), greatest(a, b), pos) - 1 AS INTEGER) AS idx, CAST(least(a, b) AS DOUBLE) AS start, CAST(greatest(a, b) AS DOUBLE) AS "end", 'e' || (p % 5) || ',e' || (s % 5) AS present FROM r""")
def flattened_segments(spark, d):
    """Segments of all scenes in the order of time; reversed ones are put right."""
    rows = flatten.flat_segments(annotations(spark, d))
    return rows.select("movie", "idx", "start", F.col("end_").alias("end"), F.array_join("present", ",").alias("present"))


def author_sources(spark, d):
    """story, doc: an order of lines as a source of one scene a return flag; every third action is an object."""
    li = table(spark, d, "lineitem").where("l_orderkey % 5 = 0")
    name = F.concat(F.lit("act "), F.col("l_partkey").cast("string"))
    action = F.when(F.col("l_partkey") % 3 == 0, F.to_json(F.struct(F.concat(name, F.lit(" ")).alias("action"), F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("own"))).alias("present"), F.array(F.struct(F.lit("mine").alias("e"))).alias("events")))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    by = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", action.alias("t")))), lambda x: x["t"])
    scene = li.groupBy(F.col("l_orderkey").alias("story"), F.col("l_returnflag").alias("flag")).agg(F.concat_ws(",", by).alias("acts"))
    text = F.concat(F.lit('{"id":"'), "flag", F.lit('","present":["all"],"events":[{"at":1,"e":"first"}],"actions":['), "acts", F.lit("]}"))
    story = scene.groupBy("story").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("flag", text.alias("t")))), lambda x: x["t"])).alias("s"))
    return story.select("story", F.try_parse_json(F.concat(F.lit('{"scenes":['), "s", F.lit("]}"))).alias("doc"))


LINES = """r AS (SELECT l_orderkey AS story, l_returnflag AS flag, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS local FROM lineitem WHERE l_orderkey % 5 = 0)"""


@query(f"""WITH {LINES} SELECT story, CAST(row_number() OVER (PARTITION BY story ORDER BY flag, local) - 1 AS INTEGER) AS idx, flag AS scene_id, 'act ' || p AS action, CASE WHEN p % 3 = 0 AND s % 2 = 0 THEN 'own' ELSE 'all' END AS present,
  CASE WHEN local = 0 THEN 'cut' ELSE 'continue' END AS transition, concat_ws(',', CASE WHEN local = 1 THEN 'first' END, CASE WHEN p % 3 = 0 THEN 'mine' END) AS events FROM r""")
def flattened_actions(spark, d):
    """Actions of author sources as segments."""
    rows = flatten.flat_actions(author_sources(spark, d))
    named = F.array_join(F.transform("events", lambda e: P.string(P.field(e, "e"))), ",")
    return rows.select("story", "idx", "scene_id", "action", F.array_join("present", ",").alias("present"), "transition", named.alias("events"))


@query(f"""WITH {LINES} SELECT story, flag AS scene_id, 'event_out_of_range' AS fault FROM r GROUP BY 1, 2 HAVING count(*) = 1""")
def author_source_faults(spark, d):
    """Scenes whose events name no action."""
    return flatten.source_faults(author_sources(spark, d))
