"""String, JSON and id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes that name an entity's kind.
KIND_SUFFIXES = "character|location|prop|char|loc"


def entity_name(name: Column) -> Column:
    """Display name without its kind suffix ("(prop)", "-prop", " prop", "_prop") and without outer quotes."""
    out = F.trim(F.coalesce(name, F.lit("")))
    for pattern in (
        rf"(?i)\s*\(\s*(?:{KIND_SUFFIXES})\s*\)?\s*$",
        rf"(?i)\s+-(?:{KIND_SUFFIXES})\s*$",
        rf"(?i)\s+(?:{KIND_SUFFIXES})\s*$",
        rf"(?i)[_-](?:{KIND_SUFFIXES})$",
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, "^[\"']+|[\"']+$", ""))


def slug(name: Column) -> Column:
    """ASCII slug; a hashed one for names without ASCII letters or digits; else ``unnamed``."""
    norm = entity_name(name)
    ascii_ = F.regexp_replace(F.regexp_replace(F.lower(norm), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return (
        F.when(ascii_ != "", ascii_)
        .when(norm.rlike(r"[\p{L}\p{N}_]"), F.concat(F.lit("u_"), F.substring(F.sha1(norm.cast("binary")), 1, 8)))
        .otherwise("unnamed")
    )


def name_in(name: Column, text: Column) -> Column:
    """Whether the text mentions the name: white space collapsed, case ignored, Latin names at token boundaries."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    n, t = flat(name), flat(text)
    edge = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))
    latin = edge.contains(F.concat(F.lit(" "), F.regexp_replace(n, "[^a-z0-9]+", " "), F.lit(" ")))
    return F.when(n == "", F.lit(False)).when(n.rlike("^[\\x00-\\x7f]*$"), latin).otherwise(t.contains(n))


def repaired_json(text: Column, schema: str) -> Column:
    """The outermost {...} of a text, parsed; single quotes and trailing commas are repaired if need be."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    plain = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    fixed = F.regexp_replace(F.translate(body, "'", '"'), r",\s*([}\]])", "$1")
    return F.coalesce(F.when(F.try_parse_json(body).isNotNull(), plain), F.from_json(fixed, schema))


def tri_state(value: Column) -> Column:
    """true, false or unsure; anything else is unsure."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "1"), "true").when(v.isin("false", "no", "0"), "false").otherwise("unsure")


def short_description(text: Column, words: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")


def run_name(base: Column, mode: Column, budget: Column) -> Column:
    """base[__descprov|__desconly][__B<n>]."""
    suffix = F.when(mode == "description_provided", "__descprov").when(mode == "description_only", "__desconly").otherwise("")
    return F.concat(base, suffix, F.when(budget.isNotNull(), F.concat(F.lit("__B"), budget.cast("string"))).otherwise(""))


def parsed_run_name(name: Column) -> Column:
    """struct(base, mode, budget) of a run name."""
    budget = F.regexp_extract(name, r"__B(\d+)$", 1)
    rest = F.regexp_replace(name, r"__B\d+$", "")
    mode = F.when(rest.endswith("__descprov"), "description_provided").when(rest.endswith("__desconly"), "description_only").otherwise("name_anchored")
    return F.struct(
        F.regexp_replace(rest, "__desc(?:prov|only)$", "").alias("base"), mode.alias("mode"),
        F.when(budget != "", budget.cast("int")).alias("budget"),
    )


def known(value: Column, allowed: list[str]) -> Column:
    """A lower-cased enum value, or ``unknown``."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise("unknown")


def numbered(base: Column, place: Column) -> Column:
    """base for the first of equal ids, base_02, base_03, ... for the next."""
    return F.when(place <= 1, base).otherwise(F.concat(base, F.format_string("_%02d", place.cast("int"))))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of a row's JSON, nulls kept, keys in the given order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hash_vector(text: Column, dim: int = 64) -> Column:
    """Unit vector from SHA-256 blocks of the text and a counter: pairs of bytes scaled to [-1, 1]."""
    blocks = [
        F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit(f"{n:08x}"))), 256) for n in range((dim + 15) // 16)
    ]
    digits = F.concat(*blocks)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535.0 * 2.0 - 1.0,
    )
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / size)
