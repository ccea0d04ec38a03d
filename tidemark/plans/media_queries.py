"""Masks, tensor files and packages made from the tables: a mask and a frame for each vector."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import features, masks
from tidemark.sources import packages, selections, tensors
from tidemark.sources.checkpoints import shared_folder

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


@query("""WITH RECURSIVE c AS (SELECT vec_id, i // 8 AS r, i % 8 AS k, coalesce(embedding[i + 1] > 0.02, FALSE) AS on_ FROM embeddings, range(64) t(i)),
w(vec_id, seed, r, k, on_) AS (SELECT vec_id, r * 8 + k, r, k, on_ FROM c
  UNION SELECT c.vec_id, w.seed, c.r, c.k, c.on_ FROM w JOIN c ON c.vec_id = w.vec_id AND c.on_ = w.on_ AND abs(c.r - w.r) + abs(c.k - w.k) = 1),
l AS (SELECT vec_id, r, k, on_, min(seed) AS part FROM w GROUP BY ALL),
p AS (SELECT vec_id, part, on_, count(*) AS n, bool_or(r IN (0, 7) OR k IN (0, 7)) AS edge FROM l GROUP BY ALL),
a AS (SELECT vec_id, CAST(coalesce(sum(n) FILTER (on_), 0) AS BIGINT) AS fg_area, count(*) FILTER (on_) AS n_parts, coalesce(max(n) FILTER (on_), 0) AS largest,
  CAST(coalesce(sum(n) FILTER (NOT on_ AND NOT edge), 0) AS BIGINT) AS holes FROM p GROUP BY vec_id),
s AS (SELECT vec_id, count(*) FILTER (on_ AND n / fg_area >= 0.02) AS n_significant FROM p JOIN a USING (vec_id) GROUP BY vec_id),
m AS (SELECT vec_id, fg_area, n_parts, n_significant, largest / greatest(fg_area, 1) AS largest_share, holes / greatest(fg_area + holes, 1) AS hole_share FROM a JOIN s USING (vec_id)),
y AS (SELECT *, concat_ws(',', CASE WHEN fg_area = 0 THEN 'empty_mask' END, CASE WHEN fg_area > 0 AND largest_share < 0.9 THEN 'largest_cc_too_small' END,
  CASE WHEN fg_area > 0 AND hole_share > 0.12 THEN 'interior_holes' END, CASE WHEN fg_area > 0 AND n_significant > 1 THEN 'too_many_fragments' END) AS reasons FROM m)
SELECT *, reasons = '' AS ok FROM y""")
def mask_quality(spark, d):
    """Parts, holes and verdict of a mask of eight by eight for each vector: the components that are well above zero."""
    on = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get("embedding", i) > 0.02, "01").otherwise("00"))
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(on, "")).alias("mask"))
    return masks.mask_quality(rows, ["vec_id"]).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT CAST(vec_id AS VARCHAR) AS key, list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)) > 0 AS nonzero, embedding::DOUBLE[] = embedding::DOUBLE[] AS equal, len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def tensor_round_trip(spark, d):
    """Every vector written to safetensors files and read back, held against the table."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    back = tensors.vectors(tensors.vector_blobs(rows, "vec_id", "embedding"))
    stored = rows.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("stored"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x))
    return stored.join(back, "key").select("key", (total > 0).alias("nonzero"), (F.col("vec") == F.col("stored")).alias("equal"), F.size("vec").cast("long").alias("n"))


@query("""WITH f AS (SELECT vec_id // 3 AS clip, vec_id % 10 >= 3 AS seen, vec_id % 4 <> 0 AS face, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT DISTINCT clip FROM f), m AS (SELECT clip, modality FROM u, (VALUES ('dino_crop'), ('location_dino')) t(modality) WHERE clip % 2 = 0 OR modality = 'location_dino'),
s AS (SELECT clip, 'dino_crop' AS modality, v FROM f WHERE seen UNION ALL SELECT clip, 'location_dino', v FROM f),
b AS (SELECT m.clip, m.modality, max(list_dot_product(x.v, y.v)) AS sim FROM m JOIN s x ON x.clip = m.clip AND x.modality = m.modality JOIN s y ON y.clip = m.clip + 1 AND y.modality = m.modality GROUP BY ALL)
SELECT CAST(m.clip AS VARCHAR) AS unit, m.modality, EXISTS (FROM s WHERE s.clip = m.clip AND s.modality = m.modality) AS det_a, EXISTS (FROM s WHERE s.clip = m.clip + 1 AND s.modality = m.modality) AS det_b, round(sim, 6) AS sim
FROM m LEFT JOIN b ON b.clip = m.clip AND b.modality = m.modality""")
def clip_similarities(spark, d):
    """Clips of three frames each, packed to NPZ files and read back; how alike a clip and the next are, by crops and by whole frames."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("clip"), "vec_id", F.col("embedding").alias("v"), ((F.col("vec_id") % 10) / 10).cast("float").alias("score"))
    frames = rows.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v", "score"))).alias("f"))
    arrays = F.create_map(F.lit("frame_dino"), F.col("f.v"), F.lit("crop__E1"), F.col("f.v"), F.lit("score__E1"), F.transform("f.score", lambda x: F.array(x)))
    blobs = tensors.clip_blobs(frames.select(F.format_string("clips/base/%d/gt001_a.npz", "clip").alias("path"), arrays.alias("arrays")))
    found = features.modality_vectors(tensors.entity_features(blobs), tensors.frame_features(blobs), 0.25)
    side = lambda at: F.struct(F.lit("base").alias("cond"), (F.col("clip") + at).cast("string").alias("story"), F.lit(1).alias("gt"), F.lit("a").alias("variant"), F.lit("E1").alias("eid"))
    units = frames.select(F.col("clip").cast("string").alias("unit"), F.when(F.col("clip") % 2 == 0, "character").otherwise("location").alias("kind"), side(0).alias("a"), side(1).alias("b"))
    out = features.unit_similarities(units, found, {"dino_crop": ["character"], "location_dino": ["character", "location"]})
    return out.withColumn("sim", F.round("sim", 6))


def shipped(spark, d):
    """movies, files, findings: a movie for each part, its files with faults by its number, findings from the lineitems."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("movie"))
    k, i = F.col("movie"), F.col("i")
    names = F.array(*map(F.lit, packages.REQUIRED))
    files = p.select("movie", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).where((k + i) % 17 != 0).select(
        "movie", F.get(names, i).alias("file"), F.when(i.isin(1, 3, 4), F.when((k % 11 == 0) & (i == 1), "").when((k % 13 == 0) & (i == 3), "v2").otherwise("v1")).alias("schema_version"),
        F.when((i == 1) & (k % 7 != 0), F.format_string("h%d", k)).alias("layout_hash"), F.when(i >= 3, k % 5 != i - 3).alias("human_reviewed"),
    )
    findings = table(spark, d, "lineitem").where("l_quantity <= 2").select(F.col("l_partkey").alias("movie"), F.col("l_linestatus").alias("code"), F.when(F.col("l_returnflag") == "A", "error").otherwise("warning").alias("severity"))
    return p, files, findings


SHIPPED = """i AS (SELECT p_partkey AS movie, i, ['manifest.json', 'gold/chunk_index.json', 'gold/shot_boundaries.csv', 'gold/entity_registry.json', 'gold/chunk_annotations.json'][i + 1] AS file,
  (p_partkey + i) % 17 <> 0 AS there FROM part, range(5) t(i)),
v AS (SELECT movie, CASE WHEN i = 1 AND movie % 11 = 0 THEN '' WHEN i = 3 AND movie % 13 = 0 THEN 'v2' ELSE 'v1' END AS version, i, file FROM i WHERE there AND i IN (1, 3, 4)),
pf AS (SELECT movie, 'missing_file' AS code, file AS detail, 'missing' AS level FROM i WHERE NOT there
UNION ALL SELECT movie, 'missing_schema_version', file, 'quality' FROM v WHERE version = ''
UNION ALL SELECT movie, 'schema_version_mismatch', 'v1 / v2', 'quality' FROM v WHERE version <> '' GROUP BY movie HAVING count(DISTINCT version) > 1
UNION ALL SELECT movie, 'missing_layout_hash', file, 'quality' FROM v WHERE i = 1 AND movie % 7 = 0
UNION ALL SELECT movie, 'not_reviewed', file, 'unfrozen' FROM v WHERE i >= 3 AND movie % 5 = i - 3
UNION ALL SELECT l_partkey, 'lint:' || l_linestatus, CAST(count(*) AS VARCHAR), 'quality' FROM lineitem WHERE l_quantity <= 2 AND l_returnflag = 'A' AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey, l_linestatus)"""


@query(f"WITH {SHIPPED} SELECT * FROM pf")
def package_faults(spark, d):
    """What keeps each movie from being published: files, versions, layout, review and lint."""
    return packages.package_faults(*shipped(spark, d))


@query(f"""WITH {SHIPPED}, n AS (SELECT DISTINCT p_partkey AS movie FROM part),
c AS (SELECT n.movie, count(*) FILTER (level = 'missing') AS n_missing, count(*) FILTER (level = 'quality') AS n_quality, count(*) FILTER (level = 'unfrozen') AS n_unfrozen FROM n LEFT JOIN pf USING (movie) GROUP BY n.movie)
SELECT *, CASE WHEN n_missing > 0 THEN 'missing' WHEN n_quality > 0 THEN 'quality' WHEN n_unfrozen > 0 THEN 'unfrozen' ELSE 'published' END AS outcome FROM c""")
def package_verdicts(spark, d):
    """Whether each movie may be published, and the gravest thing against it."""
    movies, files, findings = shipped(spark, d)
    return packages.package_verdicts(movies, packages.package_faults(movies, files, findings))


@query("""SELECT 'part' AS name, p_partkey AS id, p_name AS text FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def published_tables(spark, d):
    """Two tables published as one package, as a reader finds them after the hashes of all files were verified."""
    target = f"{shared_folder(spark)}/package-{uuid.uuid4().hex}"
    packages.publish(spark, {n: table(spark, d, n) for n in ("part", "supplier")}, target)
    if not packages.verify_package(spark, target).isEmpty():
        raise packages.NotPublished(f"{target} is not as published")
    found = packages.read_package(spark, target)
    part, supplier = (found[n].select(F.lit(n).alias("name"), F.col(f"{k}key").alias("id"), F.col(f"{k[0]}_name").alias("text")) for n, k in (("part", "p_part"), ("supplier", "s_supp")))
    return part.unionByName(supplier)


@query("""WITH r AS (SELECT l_partkey AS movie, l_linestatus AS system, CAST(l_suppkey % 4 AS INTEGER) AS chunk_id, l_orderkey * 10 + l_linenumber AS place,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'c' || l_orderkey || '_' || l_linenumber END AS crop, CASE WHEN l_orderkey % 3 = 0 THEN '/a/' || l_orderkey || '_' || l_linenumber WHEN l_orderkey % 3 = 1 THEN '' END AS whole,
  CASE WHEN l_orderkey % 10 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS seconds FROM lineitem),
i AS (SELECT *, CASE WHEN whole <> '' THEN whole ELSE crop END AS path FROM r)
SELECT CAST(movie AS VARCHAR) AS movie, system, chunk_id, coalesce(string_agg(coalesce(path, '@' || seconds), ' ' ORDER BY place) FILTER (path IS NOT NULL OR seconds IS NOT NULL), '') AS images FROM i GROUP BY ALL""")
def selection_round_trip(spark, d):
    """The lineitems as selections: gathered to a document for each movie and system, and taken apart again."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    own = F.concat(k.cast("string"), F.lit("_"), n.cast("string"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("movie"), F.col("l_linestatus").alias("system"), (F.col("l_suppkey") % 4).cast("int").alias("chunk_id"), F.lit("p").alias("prompt"),
        k.alias("item"), F.concat(F.lit("asset"), k.cast("string")).alias("asset_id"), n.alias("place"), F.lit(None).cast("string").alias("name"), F.lit("prop").alias("kind"),
        F.when(k % 5 != 0, F.concat(F.lit("c"), own)).alias("crop_path"), F.when(k % 3 == 0, F.concat(F.lit("/a/"), own)).when(k % 3 == 1, "").alias("crop_abspath"),
        F.when(k % 10 == 0, n.cast("double")).alias("source_seconds"),
    )
    parsed = selections.selection_documents(rows).select(F.from_json("document", selections.SELECTIONS).alias("x")).select("x.*")
    shown = F.transform("images", lambda i: F.coalesce(i["path"], F.concat(F.lit("@"), i["seconds"].cast("string"))))
    return selections.selected_images(parsed).select("movie", "system", "chunk_id", F.array_join(shown, " ").alias("images"))
