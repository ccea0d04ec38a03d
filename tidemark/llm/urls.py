"""URL filter: host and path rules, then a Bloom filter cascade (operator 9). Built-in functions only.

A rule names a host, with its subdomains, and a path prefix; the longest rule that
fits decides. Elsewhere the verdict is block exactly if the url's key, its host and path, is in the
table of listed keys.

The cascade answers that without a join. The universe is every key of the corpus and of the list. Level 1 holds the listed keys; level 2
the other keys of the universe that level 1 wrongly finds; level 3 the listed ones
that level 2 wrongly finds; and so on until nothing is wrongly found. Over the
complete key universe it was built from, it answers exactly. Levels shrink
geometrically from the second on; that one grows with the universe. Each is an array of words held as a constant in the plan, so its
size is bounded: where the first two need more than ``max_bits`` bits, keys are cut into shards by a hash of the key, pages and
universe are written to the shared folder by shard, and every shard has a cascade of its own
that is built and asked alone. So no list is too large for the plan or the driver.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed unless the empty key is listed; null keys in the list are ignored; an empty list allows every url; repeated rows are judged
each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import durable, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host with path), as the contract of the query has them.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: The list of the query: keys whose MD5 with this suffix begins with one of these digits, an eighth of all keys.
LISTED_SUFFIX, LISTED_DIGITS = "#listed", ("0", "1")
BITS_PER_KEY = 10
HASHES = 4
#: A level wrongly finds less than this share of what is not in it, and the next level holds that.
WRONG = 0.02


@dataclass(frozen=True)
class Level:
    bits: int
    words: str  # JSON array of 64-bit words


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + j)), F.lit(bits)) for j in range(HASHES)]


def _build(keys: DataFrame, level: int, n: int) -> Level:
    """A Bloom filter of the column ``key``; at most ``bits / 64`` numbers reach the driver."""
    bits = max(64, 1 << (n * BITS_PER_KEY - 1).bit_length())
    words = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        .collect()
    )
    out = [0] * (bits // 64)
    for r in words:
        out[r.w] = r.b
    return Level(bits, json.dumps(out))


def _found(key: Column, level: int, filt: Level) -> Column:
    words = F.from_json(F.lit(filt.words), "array<bigint>")  # folded to a constant
    hit = F.lit(True)
    for p in _positions(key, level, filt.bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        hit = hit & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit


def build_cascade(universe: DataFrame, max_levels: int = 60) -> list[Level]:
    """Levels for the distinct rows (key, listed) of a whole universe."""
    levels: list[Level] = []
    holds = F.col("listed")
    pending = universe
    while True:
        inside = pending.where(holds if len(levels) % 2 == 0 else ~holds).select("key")
        n = inside.count()
        if not n:
            return levels
        if len(levels) == max_levels:  # a level wrongly finds a fiftieth of what is not in it: this is never reached
            raise RuntimeError(f"{n} keys are left after {max_levels} levels")
        levels.append(_build(inside, len(levels), n))
        # What this level finds: its own keys, rightly, and others that the next level must hold.
        pending = pending.where(_found(F.col("key"), len(levels) - 1, levels[-1]))


def listed(key: Column, levels: list[Level]) -> Column:
    """Membership by the cascade: the first level that misses decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        answer = F.when(_found(key, k, levels[k]), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def key_universe(keys: DataFrame, list_: DataFrame) -> DataFrame:
    """key, listed: every key of either table once."""
    every = keys.select("key", F.lit(False).alias("listed")).unionByName(list_.select("key", F.lit(True).alias("listed")))
    return every.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"))


def shards_for(listed_keys: int, others: int, max_bits: int) -> int:
    """How many shards keep the first level (listed keys) and the second (others that it wrongly finds) within ``max_bits``."""
    return max(1, -(-max(listed_keys, int(others * WRONG)) * BITS_PER_KEY // max_bits))


def with_membership(rows: DataFrame, list_: DataFrame, max_bits: int = 1 << 24) -> DataFrame:
    """``rows`` with ``listed``: whether their ``key`` (not null) is a key of ``list_``."""
    universe = durable(key_universe(rows, list_))
    shards = shards_for(*universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first(), max_bits)
    if shards == 1:
        return rows.withColumn("listed", listed(F.col("key"), build_cascade(universe)))
    folder = f"{shared_folder(rows.sparkSession)}/cascade-{uuid.uuid4().hex}"
    shard = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)).cast("int")
    parts = {}
    for name, df in (("rows", rows), ("universe", universe)):
        df.withColumn("shard", shard).write.partitionBy("shard").parquet(f"{folder}/{name}")
        stored = rows.sparkSession.read.schema(StructType([*df.schema.fields, StructField("shard", IntegerType())]))
        parts[name] = stored.parquet(f"{folder}/{name}")
    judged = []
    for k in range(shards):
        mine, keys = (parts[name].where(F.col("shard") == k).drop("shard") for name in ("rows", "universe"))
        judged.append(durable(mine.withColumn("listed", listed(F.col("key"), build_cascade(keys)))))
    return reduce(DataFrame.unionByName, judged)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and key, the two together."""
    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))


def url_filter(pages: DataFrame, list_: DataFrame, rules=RULES, max_bits: int = 1 << 24) -> DataFrame:
    """page_id, host, path, rule, verdict; ``list_`` has the listed keys (host and path) in its column ``key``."""
    rows = with_membership(parsed(pages), list_, max_bits)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def listed_by_hash(pages: DataFrame, suffix: str = LISTED_SUFFIX, digits=LISTED_DIGITS) -> DataFrame:
    """A list for the query: the pages' keys chosen one by one by a keyed hash, so that no rule of words or hosts gives it."""
    chosen = F.substring(F.md5(F.concat("key", F.lit(suffix))), 1, 1).isin(*digits)
    return parsed(pages).where(chosen).select("key").distinct()


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, listed_by_hash(pages))


OP9_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/'
  END AS rule
  FROM parsed
), listed AS (
  SELECT DISTINCT host || path AS key FROM parsed WHERE substr(md5(host || path || '{LISTED_SUFFIX}'), 1, 1) IN {LISTED_DIGITS}
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

QUERIES = {"op9_urls": op9_urls}
ORACLES = {"op9_urls": OP9_SQL}
