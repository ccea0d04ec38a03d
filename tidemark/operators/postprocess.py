"""Checks and normal form of annotations: loosely typed JSON documents with entities, scenes and segments.

An annotation is a row (movie, doc) whose ``doc`` is a VARIANT, so that a field of a
wrong type is a finding and not an error. Findings are (movie, code, path, severity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The collections of an annotation, their ids, and the fields that are counted.
COLLECTIONS = (("characters", "char_id"), ("props", "prop_id"), ("locations", "loc_id"))
COUNTED = ("characters", "props", "locations", "scenes", "visual_segments")


#: What the first word of a value's schema says; all other words are numbers.
KINDS = {"VOID": "null", "OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"}


# Spark repeats a column wherever it is named, so these name ``v`` as few times as they can: what they are nested in multiplies.
def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    word = F.substring_index(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "<", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), word), F.lit("number"))


def is_object(v: Column) -> Column:
    """Whether it is an object; told without the schema of all that it holds."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def listable(v: Column) -> Column:
    """Whether it is an array, null or missing."""
    return F.try_variant_get(v, "$", "array<variant>").isNotNull() | (kind_of(v) == "null")


def field(v: Column, name: str) -> Column:
    """The field of an object; null for all else."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def number(v: Column) -> Column:
    """The value of a number; null for all else."""
    return F.when(kind_of(v) == "number", F.try_variant_get(v, "$", "double"))


def string(v: Column) -> Column:
    return F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string"))


def items(v: Column) -> Column:
    """The items of an array; none for all else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def parsed(texts: DataFrame) -> DataFrame:
    """movie, doc of the rows (movie, text); text that is no JSON gives a null doc."""
    return texts.select("movie", F.try_parse_json("text").alias("doc"))


def rule(when: Column, code: str, path: Column, severity: str = "error") -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), path.alias("path"), F.lit(severity).alias("severity")))


def findings(rows: DataFrame, *rules: Column) -> DataFrame:
    """movie, code, path, severity: all rules of a row are judged in one pass over it."""
    return rows.select("movie", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("movie", "f.code", "f.path", "f.severity")


def entities(annotations: DataFrame) -> DataFrame:
    """movie, duration, part, at, path, entity, id (null unless a string with something in it), n: the how-manieth entity of its id."""
    def listed(i: int, name: str, key: str) -> Column:
        return F.transform(
            items(field(F.col("doc"), name)),
            lambda v, k: F.struct(F.lit(i).alias("part"), k.alias("at"), v.alias("entity"), string(field(v, key)).alias("given")),
        )

    each = F.flatten(F.array(*[listed(i, name, key) for i, (name, key) in enumerate(COLLECTIONS)]))
    rows = annotations.select("movie", number(field(F.col("doc"), "video_duration_seconds")).alias("duration"), F.explode(each).alias("x")).select("movie", "duration", "x.*")
    name = F.element_at(F.array(*[F.lit(n) for n, _ in COLLECTIONS]), F.col("part") + 1)
    rows = rows.select("movie", "duration", "part", "at", F.format_string("$.%s[%d]", name, "at").alias("path"), "entity", F.when(F.col("given") != "", F.col("given")).alias("id"))
    nth = F.row_number().over(Window.partitionBy("movie", "id").orderBy("part", "at"))
    return rows.withColumn("n", F.when(F.col("id").isNotNull(), nth))


def entity_findings(annotations: DataFrame) -> DataFrame:
    """Ids, names, presence and state changes of the entities; each is judged where it lies, only ids meet."""
    path, e = F.col("path"), F.col("entity")
    named = F.concat(path, F.lit("."), F.element_at(F.array(*[F.lit(k) for _, k in COLLECTIONS]), F.col("part") + 1))
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    rows = entities(annotations.select("movie", "doc")).withColumns({
        "kind": kind_of(e), "name": field(e, "name"), "f": field(e, "first_presence_seconds"), "l": field(e, "last_presence_seconds"), "changes": field(e, "state_changes"),
        "sound": F.col("id").isNotNull(),
    })
    rows = rows.withColumns({"first": number(F.col("f")), "last": number(F.col("l")), "odd_f": ~kind_of(F.col("f")).isin("number", "null"), "odd_l": ~kind_of(F.col("l")).isin("number", "null")})
    sound, timed = F.col("sound"), F.col("sound") & ~F.col("odd_f") & ~F.col("odd_l")
    outside = lambda c: (c < 0) | (c > F.col("duration"))

    def changed(c: Column, k: Column) -> Column:
        off, seconds = F.concat(path, F.lit(".state_changes["), k.cast("string"), F.lit("]")), field(c, "seconds")
        off_s = F.concat(off, F.lit(".seconds"))
        kind = kind_of(seconds)
        return F.array(
            rule(~is_object(c), "INVALID_STATE_EVENT", off, "warning"),
            rule(is_object(c) & ~kind.isin("number", "null"), "INVALID_STATE_EVENT_TIME", off_s, "warning"),
            rule(outside(number(seconds)), "INVALID_STATE_EVENT_TIME", off_s, "warning"),
        )

    own = F.array(
        rule(F.col("kind") != "object", "INVALID_ENTITY", path),
        rule((F.col("kind") == "object") & ~sound, "MISSING_ENTITY_ID", named),
        rule(F.col("n") > 1, "DUPLICATE_ENTITY_ID", named),
        rule(sound & (F.coalesce(F.trim(string(F.col("name"))), F.lit("")) == ""), "EMPTY_ENTITY_NAME", at("name")),
        rule(sound & F.col("odd_f"), "INVALID_PRESENCE_TIME", at("first_presence_seconds"), "warning"),
        rule(sound & ~F.col("odd_f") & F.col("odd_l"), "INVALID_PRESENCE_TIME", at("last_presence_seconds"), "warning"),
        rule(timed & (F.col("first") > F.col("last")), "PRESENCE_TIME_OUT_OF_RANGE", path, "warning"),
        rule(timed & outside(F.col("first")), "PRESENCE_TIME_OUT_OF_RANGE", at("first_presence_seconds"), "warning"),
        rule(timed & outside(F.col("last")), "PRESENCE_TIME_OUT_OF_RANGE", at("last_presence_seconds"), "warning"),
        rule(sound & ~listable(F.col("changes")), "INVALID_STATE_CHANGES", at("state_changes"), "warning"),
    )
    of_changes = F.when(sound, F.flatten(F.transform(items(F.col("changes")), changed)))
    none = F.array().cast("array<struct<code:string,path:string,severity:string>>")
    return rows.select("movie", F.explode(F.array_compact(F.concat(own, F.coalesce(of_changes, none)))).alias("x")).select("movie", "x.code", "x.path", "x.severity")


def segments(annotations: DataFrame) -> DataFrame:
    """movie, scene (its place), scene_id, loc_id (of the scene), at, path, segment, id, start, end_, duration of every segment."""
    screenplay = field(F.col("doc"), "screenplay")
    scenes = annotations.select("movie", F.posexplode(items(field(screenplay, "scenes"))).alias("scene", "s"))
    scene_id = F.coalesce(string(field(F.col("s"), "scene_id")), F.format_string("scene_%d", "scene"))
    loc_id = F.trim(F.coalesce(string(field(F.col("s"), "loc_id")), F.lit("")))
    rows = scenes.select("movie", "scene", scene_id.alias("scene_id"), loc_id.alias("loc_id"), F.posexplode(items(field(F.col("s"), "visual_segments"))).alias("at", "segment"))
    seg = F.col("segment")
    return rows.select(
        "movie", "scene", "scene_id", "loc_id", "at", F.format_string("$.screenplay.scenes[%d].visual_segments[%d]", "scene", "at").alias("path"), "segment",
        F.coalesce(string(field(seg, "segment_id")), F.lit("")).alias("id"), number(field(seg, "start_seconds")).alias("start"),
        number(field(seg, "end_seconds")).alias("end_"), number(field(seg, "duration_seconds")).alias("duration"),
    )


def segment_index(annotations: DataFrame) -> DataFrame:
    """movie, segment_id, scene_id, start_seconds, end_seconds of the segments with both times."""
    rows = segments(annotations).where("start is not null and end_ is not null")
    return rows.select("movie", F.col("id").alias("segment_id"), "scene_id", F.col("start").alias("start_seconds"), F.col("end_").alias("end_seconds"))


def segment_findings(annotations: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Times, ids and presence of the segments, and the ids that the self-check names.

    A document is taken apart once, into its scenes, segments, the entities they show, its own entities and
    the segments it doubts. Ids of one kind meet in a window, in which those that are given stand before those that are only named.
    """
    doc, v = F.col("doc"), F.col("v")
    scenes = F.col("scenes")
    part = lambda name, v, scene=-1, at=-1: F.struct(
        F.lit(name).alias("what"), F.lit(scene).alias("scene"), F.lit(at).alias("at"), v.alias("v")
    )
    listed = items(scenes)
    entities_of = lambda name, key: F.transform(items(field(doc, name)), lambda x, j: part("entity", field(x, key), -1, j))
    parts = F.concat(
        F.array(part("screenplay", scenes)),
        F.transform(listed, lambda s, i: part("scene", s, i)),
        F.flatten(F.transform(listed, lambda s, i: F.transform(items(field(s, "visual_segments")), lambda x, j: part("segment", x, i, j)))),
        *[entities_of(*c) for c in COLLECTIONS],
        F.transform(items(field(field(doc, "self_check"), "low_confidence_segment_ids")), lambda x, j: part("doubt", x, -1, j)),
    )
    rows = annotations.select("movie", "doc", field(field(doc, "screenplay"), "scenes").alias("scenes"))
    rows = rows.select("movie", F.explode(parts).alias("x")).select("movie", "x.*")
    is_ = lambda *names: F.col("what").isin(*names)
    segment = is_("segment")
    rows = rows.withColumns({
        "object": F.when(is_("scene", "segment"), is_object(v)), "segments": F.when(is_("scene"), field(v, "visual_segments")), "present": F.when(segment, field(v, "present_entity_ids")),
        "id": F.when(segment, F.coalesce(string(field(v, "segment_id")), F.lit(""))).when(is_("entity"), string(v)).when(is_("doubt"), F.coalesce(string(v), F.to_json(v))),
        **{name: F.when(segment, number(field(v, f"{name}_seconds"))) for name in ("start", "end", "duration")},
    })
    late = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))
    gap = F.abs(F.col("duration") - (F.col("end") - F.col("start")))
    sound = segment & F.col("object")
    at_scene = F.format_string("$.screenplay.scenes[%d]", "scene")
    path = F.concat(at_scene, F.format_string(".visual_segments[%d]", "at"))
    at_present = F.concat(path, F.lit(".present_entity_ids"))
    own = F.array_compact(F.array(
        rule(is_("screenplay") & ~listable(v), "INVALID_SCENES", F.lit("$.screenplay.scenes")),
        rule(is_("scene") & ~F.col("object"), "INVALID_SCENE", at_scene),
        rule(is_("scene") & F.col("object") & ~listable(F.col("segments")), "INVALID_SEGMENTS", F.concat(at_scene, F.lit(".visual_segments"))),
        rule(segment & ~F.col("object"), "INVALID_SEGMENT", path),
        rule(sound & late, "INVALID_SEGMENT_TIME", path),
        rule(sound & (gap > tolerance), "SEGMENT_DURATION_MISMATCH", F.concat(path, F.lit(".duration_seconds"))),
        rule(sound & ~listable(F.col("present")), "INVALID_PRESENT", at_present),
    ))
    shown = F.when(sound, F.transform(items(F.col("present")), lambda x, k: F.struct(k.alias("k"), string(x).alias("id"), F.lit("shown").alias("what"))))
    itself = F.struct(F.lit(-1).alias("k"), F.col("id"), F.when(~segment | F.col("object"), F.col("what")).alias("what"))
    none = F.array().cast("array<struct<k:int,id:string,what:string>>")
    rows = rows.select("movie", "scene", "at", own.alias("own"), F.explode(F.concat(F.array(itself), F.coalesce(shown, none))).alias("x"))
    rows = rows.select("movie", "scene", "at", F.when(F.col("x.k") < 0, F.col("own")).alias("own"), "x.*")
    rows = rows.where((F.size("own") > 0) | is_("segment", "entity", "shown", "doubt"))
    of = F.when(is_("segment", "doubt"), "segment").when(is_("entity", "shown"), "entity")
    same = Window.partitionBy("movie", "_of", "id").orderBy("_named", "scene", "at", "k")
    rows = rows.withColumns({"_of": of, "_named": is_("shown", "doubt")})
    rows = rows.withColumns({"first": F.row_number().over(same) == 1, "told": ~F.first("_named").over(same), "before": F.lag(F.struct("_named", "scene", "at")).over(same)})
    again = F.coalesce(F.col("before") == F.struct("_named", "scene", "at"), F.lit(False))
    ids = F.array(
        rule(is_("segment") & (F.col("id") != "") & ~F.col("first"), "DUPLICATE_SEGMENT_ID", F.concat(path, F.lit(".segment_id"))),
        rule(is_("shown") & (F.coalesce("id", F.lit("")) == ""), "INVALID_PRESENT", at_present),
        rule(is_("shown") & (F.col("id") != "") & again, "DUPLICATE_PRESENT_ENTITY_ID", at_present),
        rule(is_("shown") & (F.col("id") != "") & ~F.col("told"), "UNKNOWN_PRESENT_ENTITY_ID", at_present),
        rule(is_("doubt") & ~F.col("told"), "UNKNOWN_SELF_CHECK_SEGMENT", F.lit("$.self_check.low_confidence_segment_ids")),
    )
    none = F.array().cast("array<struct<code:string,path:string,severity:string>>")
    return rows.select("movie", F.explode(F.concat(F.coalesce("own", none), F.array_compact(ids))).alias("x")).select("movie", "x.code", "x.path", "x.severity")


def counts(annotations: DataFrame) -> DataFrame:
    """``annotations`` with the number of items of every counted field."""
    scenes = items(field(field(F.col("doc"), "screenplay"), "scenes"))
    n_segments = F.aggregate(scenes, F.lit(0), lambda a, s: a + F.size(items(field(s, "visual_segments"))))
    sizes = {c: F.size(items(field(F.col("doc"), c))) for c, _ in COLLECTIONS}
    return annotations.withColumns({**sizes, "scenes": F.size(scenes), "visual_segments": n_segments})


def structure_findings(annotations: DataFrame) -> DataFrame:
    """Root, collections, screenplay and declared counts; counts that are off are warnings, as the normal form mends them."""
    doc, root = F.col("doc"), F.col("_root")
    rows = counts(annotations.select("movie", "doc")).withColumns({"_root": is_object(doc), "_play": field(doc, "screenplay"), "_declared": field(doc, "counts")})
    rows = rows.withColumns({"_played": is_object(F.col("_play")), "_counted": is_object(F.col("_declared")), **{f"_{c}": field(F.col("_declared"), c) for c in COUNTED}})
    arrays = {c: F.try_variant_get(field(doc, c), "$", "array<variant>").isNotNull() for c, _ in COLLECTIONS}
    rules = [rule(~root, "INVALID_ROOT", F.lit("$"))]
    rules += [rule(root & ~arrays[c], "INVALID_COLLECTION", F.lit(f"$.{c}")) for c, _ in COLLECTIONS]
    rules += [
        rule(root & ~F.col("_played"), "INVALID_SCREENPLAY", F.lit("$.screenplay")),
        rule(root & F.col("_played") & ~listable(field(F.col("_play"), "scenes")), "INVALID_SCENES", F.lit("$.screenplay.scenes")),
        rule(root & ~F.col("_counted"), "MISSING_COUNTS", F.lit("$.counts"), "warning"),
    ]
    for c in COUNTED:
        same = F.coalesce(number(F.col(f"_{c}")) == F.col(c), F.lit(False))
        rules.append(rule(root & (kind_of(F.col(f"_{c}")) != "null") & ~same, "COUNT_MISMATCH", F.lit(f"$.counts.{c}"), "warning"))
    return findings(rows, *rules)


def normalized(annotations: DataFrame) -> DataFrame:
    """movie, the collections in the order of their ids, scenes and their segments in the order of their starts, and true counts.

    Items without a usable key come last, in the order they had.
    """
    def ordered(values: Column, key) -> Column:
        keyed = F.transform(values, lambda v, k: F.struct(key(v).isNull().alias("none"), key(v).alias("key"), k.alias("k"), v.alias("v")))
        by = lambda a, b: (
            F.when(a["none"] != b["none"], F.when(a["none"], 1).otherwise(-1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(F.when(a["k"] < b["k"], -1).otherwise(1))
        )
        return F.transform(F.array_sort(keyed, by), lambda x: x["v"])

    doc = F.col("doc")
    start = lambda v: number(field(v, "start_seconds"))
    scenes = ordered(items(field(field(doc, "screenplay"), "scenes")), start)
    rows = counts(annotations)
    return rows.select(
        "movie", *[ordered(items(field(doc, c)), lambda v, k=k: string(field(v, k))).alias(c) for c, k in COLLECTIONS],
        F.transform(scenes, lambda s: F.struct(string(field(s, "scene_id")).alias("scene_id"), ordered(items(field(s, "visual_segments")), start).alias("visual_segments"))).alias("scenes"),
        F.struct(*[F.col(c).alias(c) for c in COUNTED]).alias("counts"),
    )
