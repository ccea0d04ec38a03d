"""Two versions of nested documents compared: one row a node, a full outer join by path, rules by patterns of paths.

Documents are VARIANT. ``nodes`` walks them a level at a time with Spark's own generator, so a
document of any size becomes rows and no document is parsed in Python. A path joins keys
by dots and numbers array elements in brackets: ``scenes[2].actions[0]``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.postprocess import kind_of
from tidemark.sources.checkpoints import durable

#: Characters that a translated text may not hold: Chinese writing, its marks and full-width forms.
CJK = r"[\u3000-\u303F\u3400-\u4DBF\u4E00-\u9FFF\uFF00-\uFFEF]"


@dataclass(frozen=True)
class Rules:
    """Patterns (regular expressions on whole paths) of what must hold between an original and its translation."""

    equal: tuple[str, ...] = ()  # values that stay as they are
    text: tuple[str, ...] = ()  # texts that are there, not blank and translated
    keys: tuple[str, ...] = ()  # objects that keep their keys
    counts: tuple[str, ...] = ()  # arrays that keep their length
    members: tuple[tuple[str, str, str], ...] = ()  # (values, a key beside them, format of the path whose keys they must be among)


# The author source's fields that a translation keeps, translates and counts.
AUTHOR_SOURCE = Rules(
    equal=(
        "story_id", "segment_sec", "gap_long_threshold", "avoidance_probe_window", "probe_target_default", r"entities\.[^.]+\.kind",
        r"lookalike_pairs\[\d+\]\.pair\[\d+\]", r"scenes\[\d+\]\.id", r"(?:.*\.)?present\[\d+\](?:\.(?:eid|count|confusable_with|anchor\.type|anchor\.resolves_to))?",
        r".*\.events\[\d+\]\.(?:type|eid|reason|shown)",
    ),
    text=(
        "title", "premise", r"entities\.[^.]+\.(?:name|appearance)", r"lookalike_pairs\[\d+\]\.(?:note|features\..*)", r"scenes\[\d+\]\.setting",
        r"scenes\[\d+\]\.actions\[\d+\](?:\.action)?", r".*\.anchor\.phrase",
    ),
    keys=("entities", "state_machines", r"lookalike_pairs\[\d+\]\.features"),
    counts=("lookalike_pairs", "scenes", r"scenes\[\d+\]\.actions", r"(?:.*\.)?present", r"state_machines\.[^.]+"),
    members=((r"(?:.*\.)?present\[\d+\]\.state", "eid", "entities.%s.states"), (r".*\.events\[\d+\]\.to", "eid", "entities.%s.states")),
)


def nodes(documents: DataFrame) -> DataFrame:
    """id, path, parent, kind, value (JSON of a scalar) of every node of the documents (id, doc); null documents have none."""
    spark = documents.sparkSession
    level = documents.where(F.col("doc").isNotNull()).select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.col("doc").alias("v"))
    found = []
    while True:
        kind = kind_of(F.col("v"))
        value = F.when(~kind.isin("object", "array"), F.to_json("v"))
        rows = durable(level.select("id", "path", "parent", kind.alias("kind"), value.alias("value"), F.when(kind.isin("object", "array"), F.to_json("v")).alias("inside")))
        found.append(rows.drop("inside"))
        open_ = rows.where("inside is not null")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        above = open_.select("id", F.col("path").alias("parent"), F.parse_json("inside").alias("outer_v"))
        child = above.lateralJoin(spark.tvf.variant_explode(F.col("outer_v").outer()))
        step = F.when(F.col("key").isNull(), F.concat("parent", F.lit("["), "pos", F.lit("]"))).when(F.col("parent") == "", F.col("key")).otherwise(F.concat("parent", F.lit("."), "key"))
        level = child.select("id", step.alias("path"), "parent", F.col("value").alias("v"))


def like(path: Column, patterns: tuple[str, ...]) -> Column:
    return path.rlike("^(?:" + "|".join(patterns) + ")$") if patterns else F.lit(False)


def differences(originals: DataFrame, translations: DataFrame, rules: Rules = AUTHOR_SOURCE, foreign: str = CJK) -> DataFrame:
    """id, code, path: where a translation (id, doc) does not keep to its original; every rule is judged by itself, and
    values and texts where the original has them.

    identifier_changed, empty_text, not_translated, keys_changed, count_changed, not_a_member, text_left (once a
    document, if any text or key still has foreign characters), missing_document.
    """
    left, right = (durable(nodes(d)) for d in (originals, translations))
    a = left.select("id", "path", F.col("parent").alias("a_parent"), F.col("kind").alias("a_kind"), F.col("value").alias("a_value"))
    b = right.select("id", "path", F.col("parent").alias("b_parent"), F.col("kind").alias("b_kind"), F.col("value").alias("b_value"))
    there = right.select("id").distinct()
    both = durable(a.join(b, ["id", "path"], "full").join(there, "id", "left_semi"))
    path, parent = F.col("path"), F.coalesce("a_parent", "b_parent")
    alone = F.col("a_kind").isNull() | F.col("b_kind").isNull()
    text = F.col("b_value").substr(F.lit(2), F.length("b_value") - 2)  # without its quotes
    blank = (F.coalesce(F.col("b_kind"), F.lit("")) != "string") | text.rlike(r"^(?:\\[ntrbf]|\s)*$")

    def told(rows: DataFrame, code: str, at: Column) -> DataFrame:
        return rows.select("id", F.lit(code).alias("code"), at.alias("path")).distinct()

    must = both.where(like(path, rules.text) & (F.col("a_kind") == "string"))
    out = [
        told(both.where(like(path, rules.equal) & F.col("a_value").isNotNull() & ~F.col("a_value").eqNullSafe(F.col("b_value"))), "identifier_changed", path),
        told(must.where(blank), "empty_text", path),
        told(must.where(~blank & text.rlike(foreign)), "not_translated", path),
        told(both.where(like(parent, rules.keys) & alone), "keys_changed", parent),
        told(both.where(like(parent, rules.counts) & alone), "count_changed", parent),
        told(right.where(((F.col("kind") == "string") & F.col("value").rlike(foreign)) | F.coalesce(F.regexp_extract("path", r"([^.\[\]]+)$", 1), F.lit("")).rlike(foreign)), "text_left", F.lit("")),
        told(originals.select("id").join(translations.where("doc is not null").select("id"), "id", "left_anti"), "missing_document", F.lit("")),
    ]
    plain = F.expr("substr(value, 2, length(value) - 2)")
    keyed = right.select("id", F.col("parent").alias("owner"), F.regexp_extract("path", r"([^.]+)$", 1).alias("member"))
    for values, sibling, owner in rules.members:
        asked = right.where(like(F.col("path"), (values,)) & (F.col("kind") == "string")).select("id", "path", "parent", plain.alias("member"))
        beside = right.where(F.col("path") == F.concat("parent", F.lit(f".{sibling}"))).select("id", "parent", F.format_string(owner, plain).alias("owner"))
        out.append(told(asked.join(beside, ["id", "parent"]).join(keyed, ["id", "owner", "member"], "left_anti"), "not_a_member", F.col("path")))
    return reduce(DataFrame.unionByName, out)
