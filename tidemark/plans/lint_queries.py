"""Rule sets on a registry drawn from the part and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lint as L

from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def registry(spark, d):
    """entities, reps, events, chunks, movies: parts are entities of fifty movies, lineitems their crops, line numbers the chunks."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    kind = F.when(F.col("p_partkey") % 3 == 0, "character").when(F.col("p_partkey") % 3 == 1, "prop").otherwise("location")
    head = F.when(F.col("p_partkey") % 13 == 0, F.lit("x")).otherwise(F.substring(kind, 1, 4))
    tail = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("_"), kind)).otherwise("")
    ents = p.select(
        (F.col("p_partkey") % 50).alias("movie"), F.concat(head, F.lit("_"), F.col("p_size").cast("string"), tail).alias("entity_id"),
        kind.alias("kind"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("name"), "p_partkey",
    )
    rep = F.format_string("%s@%d_%d", F.col("entity_id"), F.col("l_orderkey"), F.col("l_linenumber"))
    key = F.col("l_orderkey")
    wide = key % 19 == 0
    box = F.array(
        F.when(wide, F.lit(0)).otherwise((F.col("l_suppkey") % 5 * 100)).cast("long"), F.when(wide, F.lit(0)).otherwise((key % 4 * 100)).cast("long"),
        F.when(wide, F.lit(1000)).otherwise((F.col("l_suppkey") % 5 * 100 + 300)).cast("long"), F.when(wide, F.lit(990)).otherwise((key % 4 * 100 + 400)).cast("long"),
    )
    # Spark takes the entities for small, by the size of their numbers, and would send them to every task as texts.
    crops = li.join(ents.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    reps = crops.select(
        "movie", "entity_id", "kind", rep.alias("representation_id"), (F.col("l_linenumber") - 2).cast("long").alias("chunk_id"), box.alias("bbox"),
        F.when(key % 50 == 0, "grounding_dino").otherwise("fullframe").alias("bbox_source"),
        F.when(key % 17 == 0, "other").when(key % 3 == 0, "").otherwise(rep).alias("embedding_key"),
        F.when(key % 5 == 0, F.concat(F.lit("tmp/"), "entity_id")).when(key % 5 == 1, F.concat(F.lit("assets/"), "entity_id", F.lit("/a.png"))).otherwise(
            F.concat(F.lit("assets/"), "kind", F.lit("s/"), "entity_id", F.lit("/b.png"))
        ).alias("crop_path"),
    )
    events = crops.where(key % 40 == 0).select("movie", "entity_id", F.concat(F.lit("ev_"), key.cast("string")).alias("event_id"), F.col("l_linenumber").cast("long").alias("chunk_id"), F.array(rep).alias("deprecates"))
    seen = crops.where(key % 10 == 0).select("movie", F.col("l_linenumber").cast("long").alias("chunk_id"), F.when(key % 90 == 0, "char_ghost").otherwise(F.col("entity_id")).alias("eid"), (key % 20 == 0).alias("first"), (key % 70 == 0).alias("odd"))
    banned = crops.where((key % 40 == 0) & (key % 80 != 0)).select("movie", F.col("l_linenumber").cast("long").alias("since"), rep.alias("rep"), F.concat(F.lit("ev_"), key.cast("string")).alias("reason"))
    grid = seen.groupBy("movie", "chunk_id").agg(
        F.array_sort(F.collect_list("eid")).alias("present"), F.collect_set(F.when(F.col("first"), F.col("eid"))).alias("firsts"), F.bool_or("odd").alias("odd"),
    ).where("(movie + chunk_id) % 23 != 0")
    firsts = F.when(F.col("odd"), F.array_append("firsts", "char_odd")).otherwise(F.col("firsts"))
    told = banned.groupBy("movie").agg(F.collect_set(F.struct("since", "rep", "reason")).alias("told"))
    rows = grid.join(told, "movie", "left")
    forbidden = F.transform(F.filter("told", lambda b: b["since"] < F.col("chunk_id")), lambda b: F.struct(b["rep"].alias("representation_id"), b["reason"].alias("reason")))
    none = F.array().cast("array<struct<representation_id:string,reason:string>>")
    chunks = rows.select(
        "movie", "chunk_id", "present", firsts.alias("first_appearances"),
        F.when(F.col("movie") % 11 == 0, F.format_string("Walk CONTINUES in this location (chunk %d)", "chunk_id")).otherwise("Walk on.").alias("prompt"),
        F.transform("present", lambda e: F.struct(e.alias("entity_id"), F.when(F.array_contains("firsts", e), "introduce").otherwise("continuity").alias("requirement"))).alias("instructions"),
        F.coalesce(forbidden, none).alias("forbidden"),
    )
    chunks = chunks.withColumn("instructions", F.when(F.col("movie") % 9 == 0, F.slice("instructions", 1, 1)).otherwise(F.col("instructions")))
    again = chunks.where("movie = 7 and chunk_id = 3")
    movies = ents.select("movie").distinct().select(
        "movie", F.when(F.col("movie") % 4 == 0, "seeded").when(F.col("movie") % 4 == 1, "auto").otherwise(F.lit(None)).alias("roster_mode"),
        (F.col("movie") % 2 == 0).alias("production_mode"), F.when(F.col("movie") % 3 == 0, F.lit(7)).cast("long").alias("layout_chunks"),
        F.when(F.col("movie") % 6 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("flagged"),
    )
    return ents.drop("p_partkey"), reps, events, chunks.unionByName(again), movies


REGISTRY = """ents AS (SELECT p_partkey % 50 AS movie, p_partkey, kind, name,
  (CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE substr(kind, 1, 4) END) || '_' || p_size || (CASE WHEN p_partkey % 7 = 0 THEN '_' || kind ELSE '' END) AS entity_id
  FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'character' WHEN 1 THEN 'prop' ELSE 'location' END AS kind, p_name || ' ' || p_size AS name FROM part)),
crops AS (SELECT e.*, l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s, entity_id || '@' || l_orderkey || '_' || l_linenumber AS rep FROM lineitem JOIN ents e ON l_partkey = p_partkey),
reps AS (SELECT *, n - 2 AS chunk_id, CASE WHEN k % 19 = 0 THEN [0, 0, 1000, 990] ELSE [s % 5 * 100, k % 4 * 100, s % 5 * 100 + 300, k % 4 * 100 + 400] END AS bbox,
  k % 50 = 0 AS dino, CASE WHEN k % 17 = 0 THEN 'other' WHEN k % 3 = 0 THEN '' ELSE rep END AS ekey,
  CASE k % 5 WHEN 0 THEN 'tmp/' || entity_id WHEN 1 THEN 'assets/' || entity_id || '/a.png' ELSE 'assets/' || kind || 's/' || entity_id || '/b.png' END AS crop FROM crops),
evs AS (SELECT movie, rep, 'ev_' || k AS reason, n AS since, k FROM crops WHERE k % 40 = 0),
seen AS (SELECT movie, n AS chunk_id, CASE WHEN k % 90 = 0 THEN 'char_ghost' ELSE entity_id END AS eid, k % 20 = 0 AS first, k % 70 = 0 AS odd FROM crops WHERE k % 10 = 0),
grid AS (SELECT movie, chunk_id, list_sort(list(eid)) AS present, coalesce(list(DISTINCT eid) FILTER (first), []) AS firsts, bool_or(odd) AS odd FROM seen GROUP BY ALL HAVING (movie + chunk_id) % 23 <> 0),
once AS (SELECT movie, chunk_id, present, firsts, CASE WHEN odd THEN list_append(firsts, 'char_odd') ELSE firsts END AS first_appearances FROM grid),
ch AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE movie = 7 AND chunk_id = 3),
mv AS (SELECT DISTINCT movie FROM ents)"""

MOVIE_SQL = f"""WITH {REGISTRY}
SELECT movie, 'production_roster_mode_mismatch' AS code, '' AS path, 'error' AS severity FROM mv WHERE movie % 2 = 0 AND movie % 4 <> 0
UNION ALL SELECT movie, 'flagged_chunks', '', 'error' FROM mv WHERE movie % 6 = 0
UNION ALL SELECT movie, 'unconfirmed_roster', '', 'error' FROM mv WHERE movie % 4 = 1"""


@query(MOVIE_SQL)
def roster_lint(spark, d):
    """Roster modes and flagged chunks under the strict rules of a freeze."""
    return L.movie_rules(registry(spark, d)[4], strict=True)


ENTITY_SQL = f"""WITH {REGISTRY}, base AS (SELECT *, regexp_replace(entity_id, '(_character|_prop|_location)$', '') AS base FROM ents),
al AS (SELECT movie, kind || ':' || regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS alias FROM ents)
SELECT movie, 'duplicate_entity_id' AS code, '' AS path, 'error' AS severity FROM (SELECT DISTINCT movie FROM ents GROUP BY movie, entity_id HAVING count(*) > 1)
UNION ALL SELECT movie, 'suffix_alias_entity', 'entities[' || entity_id || ']', 'error' FROM base b WHERE base <> entity_id AND EXISTS (SELECT 1 FROM ents e WHERE e.movie = b.movie AND e.entity_id = b.base)
UNION ALL SELECT movie, 'entity_id_prefix', 'entities[' || entity_id || ']', 'error' FROM ents WHERE kind = 'character' AND NOT starts_with(entity_id, 'char_')
UNION ALL SELECT movie, 'canonical_alias_split', alias, 'error' FROM al GROUP BY movie, alias HAVING count(*) > 1
UNION ALL SELECT movie, 'bad_rep_chunk', 'entities[' || entity_id || '].representations', 'error' FROM reps WHERE chunk_id < 0
UNION ALL SELECT movie, 'embedding_key_mismatch', 'entities[' || entity_id || '].representations', 'error' FROM reps WHERE ekey <> '' AND ekey <> rep
UNION ALL SELECT movie, 'oversized_bbox', 'entities[' || entity_id || '].representations', 'error' FROM reps WHERE dino AND kind <> 'location' AND k % 19 = 0
UNION ALL SELECT movie, 'non_asset_crop_path', 'entities[' || entity_id || '].representations', 'warning' FROM reps WHERE k % 5 = 0"""


@query(ENTITY_SQL)
def entity_lint(spark, d):
    """Ids, aliases and representations of a registry."""
    ents, reps, *_ = registry(spark, d)
    return L.entity_rules(ents, reps)


CHUNK_SQL = f"""WITH {REGISTRY}, cnt AS (SELECT movie, count(*) AS n, count(DISTINCT chunk_id) AS n_ids, min(chunk_id) AS lo, max(chunk_id) AS hi FROM ch GROUP BY 1),
each AS (SELECT movie, chunk_id, first_appearances, firsts, present, unnest(present) AS eid, generate_subscripts(present, 1) AS at FROM ch),
due AS (SELECT DISTINCT c.movie, c.chunk_id, e.rep, e.reason FROM once c JOIN evs e ON e.movie = c.movie AND e.since < c.chunk_id),
has AS (SELECT DISTINCT c.movie, c.chunk_id, e.rep, e.reason FROM once c JOIN evs e ON e.movie = c.movie AND e.since < c.chunk_id WHERE e.k % 80 <> 0),
miss AS (SELECT DISTINCT movie, chunk_id FROM due ANTI JOIN has USING (movie, chunk_id, rep, reason)),
g AS (SELECT * FROM reps WHERE dino AND kind <> 'location'),
pr AS (SELECT a.movie, a.chunk_id, greatest(0, least(a.bbox[3], b.bbox[3]) - greatest(a.bbox[1], b.bbox[1])) * greatest(0, least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2])) AS i,
  (a.bbox[3] - a.bbox[1]) * (a.bbox[4] - a.bbox[2]) + (b.bbox[3] - b.bbox[1]) * (b.bbox[4] - b.bbox[2]) AS s
  FROM g a JOIN g b ON a.movie = b.movie AND a.chunk_id = b.chunk_id AND a.rep < b.rep AND a.entity_id <> b.entity_id SEMI JOIN once o ON o.movie = a.movie AND o.chunk_id = a.chunk_id)
SELECT movie, 'duplicate_chunk_id' AS code, '' AS path, 'error' AS severity FROM cnt WHERE n <> n_ids
UNION ALL SELECT movie, 'non_contiguous_chunks', '', 'error' FROM cnt WHERE n <> hi - lo + 1 OR n <> n_ids
UNION ALL SELECT movie, 'layout_chunk_count_mismatch', '', 'error' FROM mv LEFT JOIN cnt USING (movie) WHERE movie % 3 = 0 AND coalesce(n, 0) <> 7
UNION ALL SELECT movie, 'duplicate_present', 'chunks[' || chunk_id || ']', 'error' FROM ch WHERE len(present) <> len(list_distinct(present))
UNION ALL SELECT movie, 'unknown_present_entity', 'chunks[' || chunk_id || ']', 'error' FROM (SELECT DISTINCT movie, chunk_id FROM each ANTI JOIN (SELECT movie, entity_id AS eid FROM ents) USING (movie, eid))
UNION ALL SELECT movie, 'first_not_present', 'chunks[' || chunk_id || ']', 'error' FROM ch WHERE len(list_filter(first_appearances, lambda e: NOT list_contains(present, e))) > 0
UNION ALL SELECT movie, 'placeholder_prompt', 'chunks[' || chunk_id || ']', 'warning' FROM ch WHERE movie % 11 = 0
UNION ALL SELECT movie, 'instruction_mismatch', 'chunks[' || chunk_id || ']', 'error' FROM each WHERE movie % 9 = 0 AND eid <> present[1]
UNION ALL SELECT movie, 'forbidden_mismatch', 'chunks[' || chunk_id || ']', 'error' FROM ch SEMI JOIN miss USING (movie, chunk_id)
UNION ALL SELECT movie, 'same_chunk_bbox_conflict', 'chunks[' || chunk_id || ']', 'error' FROM pr WHERE i > 0 AND i / CAST(s - i AS DOUBLE) >= 0.95"""


@query(CHUNK_SQL)
def chunk_lint(spark, d):
    """Chunk ids, presence, prompts, instructions, forbidden tables and box conflicts."""
    return L.chunk_rules(*registry(spark, d))


@query(f"""WITH f AS ({MOVIE_SQL.replace("'flagged_chunks', '', 'error'", "'flagged_chunks', '', 'warning'").split("UNION ALL SELECT movie, 'unconfirmed_roster'")[0]} UNION ALL SELECT * FROM ({ENTITY_SQL}) UNION ALL SELECT * FROM ({CHUNK_SQL})),
m AS (SELECT DISTINCT p_partkey % 50 AS movie FROM part)
SELECT m.movie, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM m LEFT JOIN f USING (movie) GROUP BY m.movie""")
def publish_gate(spark, d):
    """Whether each movie may be published: no finding of severity error."""
    parts = registry(spark, d)
    return L.publishable(L.lint_registry(*parts), parts[4])


@query(f"""WITH f AS ({ENTITY_SQL})
SELECT 0 AS part, '' AS "key", '# Registry' AS line UNION ALL SELECT 2, '', '## Findings'
UNION ALL SELECT 1, code, '- `' || code || '`: ' || count(*) FROM f GROUP BY code
UNION ALL SELECT 3, movie || '|' || code || '|' || path, '- **' || severity || '** `' || code || '`' || CASE WHEN path <> '' THEN ' `' || path || '`' ELSE '' END FROM f""")
def lint_markdown(spark, d):
    """The lines of the Markdown report of the entity rules."""
    ents, reps, *_ = registry(spark, d)
    return L.lint_report(L.entity_rules(ents, reps), "Registry")
