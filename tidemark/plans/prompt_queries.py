"""Prompts of the benchmark items: a text is an action, its first words are the names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents, prompts

from .bindings import table

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def actions(spark, d):
    """item_id, action, w (its words)."""
    rows = table(spark, d, "benchmark").select("item_id", F.trim("text").alias("action"))
    return rows.withColumn("w", F.split("action", " "))


ACTIONS = "b AS (SELECT item_id, trim(text) AS action, string_split(trim(text), ' ') AS w FROM benchmark)"


@query(f"""WITH RECURSIVE {ACTIONS},
r AS (SELECT item_id, unnest(['a', 'b', 'c', 'd', 'e']) AS eid, unnest([w[1], w[1] || ' ' || w[2], w[3], substr(w[1], 1, 2), 'zzz9']) AS name FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(name) DESC, eid) AS k FROM r WHERE name IS NOT NULL),
st AS (SELECT item_id, action, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s BIGINT, e BIGINT, d VARCHAR)[]) AS taken, CAST([] AS VARCHAR[]) AS missing FROM b
  UNION ALL SELECT item_id, action, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, {{s: p, e: p + length(name), d: eid}}) END, CASE WHEN p IS NULL THEN list_append(missing, eid) ELSE missing END
  FROM (SELECT o.item_id, st.action, o.k, o.name, o.eid, st.taken, st.missing,
    list_filter(range(1, length(st.action) - length(o.name) + 2), lambda p: substr(st.action, p, length(o.name)) = o.name AND len(list_filter(st.taken, lambda t: t.s < p + length(o.name) AND p < t.e)) = 0)[1] AS p
    FROM st JOIN o ON o.item_id = st.item_id AND o.k = st.k + 1)),
l AS (SELECT item_id, action, list_sort(taken) AS t, missing FROM st QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1)
SELECT item_id, array_to_string(list_transform(t, lambda x, i: substr(action, CASE WHEN i = 1 THEN 1 ELSE t[i - 1].e END, x.e - CASE WHEN i = 1 THEN 1 ELSE t[i - 1].e END) || '（looks of ' || x.d || '）'), '')
  || CASE WHEN len(t) = 0 THEN action ELSE substr(action, t[len(t)].e) END AS prompt, array_to_string(missing, ',') AS missing FROM l""")
def spliced_prompts(spark, d):
    """Looks behind names, the longest name first, none inside another."""
    w = lambda k: F.get("w", F.lit(k))
    named = [("a", w(0)), ("b", F.concat(w(0), F.lit(" "), w(1))), ("c", w(2)), ("d", F.substring(w(0), 1, 2)), ("e", F.lit("zzz9"))]
    reveals = F.filter(F.array(*[F.struct(n.alias("name"), F.lit(e).alias("eid"), F.lit(f"looks of {e}").alias("text")) for e, n in named]), lambda r: r["name"].isNotNull())
    done = prompts.rendered(actions(spark, d).withColumn("reveals", reveals), ["item_id"])
    return done.select("item_id", "prompt", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {ACTIONS}, r AS (SELECT item_id, unnest(['a', 'b', 'c', 'd']) AS eid, unnest([translate(w[2], '{LOWER}', '{UPPER}'), substr(w[1], 1, 3), w[3] || ' ' || w[4], CASE WHEN item_id % 3 = 0 THEN ' ' ELSE 'nobody.' END]) AS name FROM b),
n AS (SELECT item_id, eid, trim(coalesce(name, '')) AS name, trim(regexp_replace(lower(coalesce(name, '')), '\\s+', ' ', 'g')) AS needle, trim(regexp_replace(lower(action), '\\s+', ' ', 'g')) AS hay FROM r JOIN b USING (item_id))
SELECT item_id, eid, name, CASE WHEN name = '' THEN 'empty_canonical_name' ELSE 'action_missing_canonical_name' END AS reason FROM n
WHERE name = '' OR NOT CASE WHEN regexp_full_match(needle, '[a-z0-9][a-z0-9 _''-]*') THEN regexp_matches(hay, '(^|[^a-z0-9])' || needle || '($|[^a-z0-9])') ELSE contains(hay, needle) END""")
def missing_canonical_names(spark, d):
    """Present entities that an action doesn't name."""
    rows = actions(spark, d)
    w = lambda k: F.get("w", F.lit(k))
    nobody = F.when(F.col("item_id") % 3 == 0, " ").otherwise("nobody.")
    named = [("a", F.translate(w(1), LOWER, UPPER)), ("b", F.substring(w(0), 1, 3)), ("c", F.concat(w(2), F.lit(" "), w(3))), ("d", nobody)]
    roster = rows.select("item_id", F.explode(F.array(*[F.struct(F.lit(e).alias("eid"), n.alias("name")) for e, n in named])).alias("x")).select("item_id", "x.eid", "x.name")
    segments = rows.select("item_id", "action", F.array(*map(F.lit, ["d", "a", "b", "c", "a", ""])).alias("present"))
    return prompts.missing_names(segments, roster, ["item_id"], "item_id")


def translations(spark, d):
    """(originals, translations): a document a customer, and a version of it with faults by the customer's number."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    scene = lambda bad, what, state: F.concat(
        F.lit('{"id":"s'), k % 4, F.when(bad & every(17), F.lit("")).otherwise(F.concat(F.lit('","setting":"'), what)),
        F.lit('","present":["e1",{"eid":"e2","state":"'), state, F.lit('"}],"actions":["'), what, F.when(bad & every(11), F.lit('"]}')).otherwise(F.concat(F.lit('",{"action":"'), what, F.lit('","events":[{"type":"t","eid":"e2"}]}]}'))),
    )
    text = lambda bad, what: F.concat(
        F.lit('{"story_id":'), F.when(bad & every(3), k + 1).otherwise(k), F.lit(',"title":"'), F.when(bad & every(4), F.lit(" ")).when(bad & every(5), F.lit("海 Sea")).otherwise(F.concat(what, F.lit(" of "), "c_name")),
        F.lit('","entities":{"e1":{"kind":"prop","name":"'), what, F.lit('"},"e2":{"kind":"character","name":"'), what, F.lit('","states":{"old":"'), what, F.lit('"}}'),
        F.when(bad & every(7), F.lit(',"e3":{"kind":"prop","name":"More"}')).otherwise(""), F.lit('},"scenes":['), scene(bad, what, F.when(bad & every(13), F.lit("lost")).otherwise("old")), F.lit("]}"),
    )
    doc = lambda bad, what: c.where(~(every(19) & F.lit(bad))).select(k.alias("id"), F.parse_json(text(F.lit(bad), F.lit(what))).alias("doc"))
    return doc(False, "海燕"), doc(True, "Petrel")


@query("""WITH t AS (SELECT c_custkey AS id FROM customer), h AS (SELECT id FROM t WHERE id % 19 <> 0)
SELECT id, 'identifier_changed' AS code, 'story_id' AS path FROM h WHERE id % 3 = 0
UNION ALL SELECT id, 'identifier_changed', 'scenes[0].actions[1].events[0].' || unnest(['type', 'eid']) FROM h WHERE id % 11 = 0
UNION ALL SELECT id, 'empty_text', 'title' FROM h WHERE id % 4 = 0
UNION ALL SELECT id, unnest(['not_translated', 'text_left']), unnest(['title', '']) FROM h WHERE id % 5 = 0 AND id % 4 <> 0
UNION ALL SELECT id, 'keys_changed', 'entities' FROM h WHERE id % 7 = 0
UNION ALL SELECT id, 'count_changed', 'scenes[0].actions' FROM h WHERE id % 11 = 0
UNION ALL SELECT id, 'empty_text', 'scenes[0].actions[1].action' FROM h WHERE id % 11 = 0
UNION ALL SELECT id, 'not_a_member', 'scenes[0].present[1].state' FROM h WHERE id % 13 = 0
UNION ALL SELECT id, 'empty_text', 'scenes[0].setting' FROM h WHERE id % 17 = 0
UNION ALL SELECT id, 'missing_document', '' FROM t WHERE id % 19 = 0""")
def translation_faults(spark, d):
    """Where a translated author source does not keep to its original."""
    return documents.differences(*translations(spark, d))
