"""Near-duplicate documents by bottom-k sketches (operator 5).

One hash function orders the shingles of a document; its ``k`` smallest values
are its sketch. Documents with one and the same shingle set are a class and go on
as one. Inverted lists of the retained values give candidates: two documents of
Jaccard ``SIMILAR`` or more share at least ``least_shared`` of their retained
values (for k = 64 all but one pair in 10^8 right at the limit, far fewer above it;
with fewer shingles than k the sketch is the whole set and the bound is certain), so they
meet in a list of one of their ``size - least_shared + 1`` rarest values, and only
those are indexed. Text that many documents share is common in the lists and drops
out of that prefix, unless it makes up most of a document.

The ``k`` smallest values of two sketches together are the sketch of the union, and
the share of them that both hold estimates the Jaccard similarity. Every candidate
must reach an estimate of ``shared / k`` (0.5; where the union has ``k`` values or
fewer the estimate is exact and must reach ``SIMILAR``); what passes is verified by
exact Jaccard on the full shingle sets (64-bit hashes).

No list is expanded into its pairs. Rounds link each document with a few pivots
of its lists, verify, and join what is linked. In the end a list's members outside
its largest component are held against that component in blocks bounded by the
number of their shingles, and
the members of small lists by the count of the retained values they share; a pair is met in one
list only, and only what passes is emitted. Members of one component
need no further comparison, so all components are found.

Edge cases: a text with fewer words than a shingle is one shingle; a text without
words has an empty set and links with nothing; every row is a document of its own,
whatever its doc_id, so links also run through rows without one; a component's id is its
smallest doc_id, null if all its rows have none;
repeated rows return each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import components, joined_components

from .common import WordHash, binary, durable, hand_back, mix, window_hashes, word_hashes

SIMILAR = (80, 100)  # 100 * intersection >= 80 * union
SKETCH = 64
SHARED = 32
#: Documents and shingles that one side of a block of comparisons holds at most.
BLOCK = 2048
BLOCK_VALUES = 1 << 20


def shingle_set(raw: bytes | None, width: int, table: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes (signed, as Spark has them) of the text's shingles, A-Z lower-cased."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = word_hashes(words, table)
    if len(words) < width:
        return mix(window_hashes(h, len(words), seed=len(words))).view(np.int64)
    return np.unique(window_hashes(h, width).view(np.int64))


def least_shared(size: int, k: int = SKETCH, shared: int = SHARED) -> int:
    """Values that the sketch of a set of ``size`` shares with that of any similar set."""
    return shared if size >= k else max(1, math.ceil(0.75 * size))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in batches:
            sizes, keys, kept = [], [], []
            for raw in binary(batch.column(2)):
                s = shingle_set(raw, width, table)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                kept.append(s[:k])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "sketch"],
            )
        del table
        hand_back()

    return run


def _full_sets(width: int):
    """Full sets of the nodes of a task, one for each though copies of its row meet here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = WordHash(), set()
        for batch in batches:
            nodes, sets = [], []
            for node, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True):
                if node in seen:
                    continue
                s = shingle_set(raw, width, table)
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "full"])
        del table, seen
        hand_back()

    return run


def inverted_lists(classes: DataFrame, k: int, shared: int) -> DataFrame:
    """(value, node, n): the rarest retained values of each class, where two classes at least hold them."""
    entries = classes.select("node", "n", F.explode("sketch").alias("value"))
    held = entries.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    size = F.least("n", F.lit(k))
    least = F.when(F.col("n") >= k, F.lit(shared)).otherwise(F.greatest(F.lit(1), F.ceil(0.75 * F.col("n"))))
    unique = size - F.size("values")  # values that no other class holds come first in the order
    return (
        entries.join(held, "value")
        .groupBy("node", "n")
        .agg(F.collect_list(F.struct("holders", "value")).alias("values"))  # k values at most
        .withColumn("prefix", (size - least + 1 - unique).cast("int"))
        .where("prefix > 0")
        .select("node", "n", F.explode(F.slice(F.array_sort("values"), F.lit(1), F.col("prefix"))).alias("x"))
        .select(F.col("x.value").alias("value"), "node", "n")
    )


def promising(a: Column, b: Column, k: int, shared: int) -> Column:
    """Whether the union sketch of two sorted sets lets them be similar."""
    part, whole = SIMILAR
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(x, y), union))
    return F.when(F.size(union) < k, whole * both >= part * F.size(union)).otherwise(both >= shared)


def may_be_similar(a: frozenset, b: frozenset, k: int, shared: int) -> bool:
    """The same of two sketches in Python."""
    part, whole = SIMILAR
    both = a & b
    if len(both) < min(shared, least_shared(max(len(a), len(b)), k, shared)):
        return False
    union = sorted(a | b)[:k]
    n = sum(x in both for x in union)
    return whole * n >= part * len(union) if len(union) < k else n >= shared


def verified(pairs: DataFrame, sets: DataFrame, k: int = SKETCH, shared: int = SHARED) -> DataFrame:
    """The pairs (u, v) whose union sketches let them be similar and whose full sets are."""
    part, whole = SIMILAR
    a = sets.select(F.col("node").alias("u"), F.col("full").alias("fu"))
    b = sets.select(F.col("node").alias("v"), F.col("full").alias("fv"))
    both = F.size(F.array_intersect("fu", "fv")).cast("long")
    similar = whole * both >= part * (F.size("fu") + F.size("fv") - both)
    hopeful = promising(F.col("fu"), F.col("fv"), k, shared)
    return pairs.join(a, "u").join(b, "v").where(F.when(hopeful, similar).otherwise(F.lit(False))).select("u", "v")


def _sizes_fit(a: str, b: str):
    part, whole = SIMILAR
    return whole * F.least(a, b) >= part * F.greatest(a, b)


def pivot_pairs(lists: DataFrame) -> DataFrame:
    """(u, v) with u > v: each list's members with its pivot, the member of least hash with the list's value."""
    order = F.xxhash64("value", "node")
    pivots = lists.groupBy("value").agg(
        F.min(F.struct(order.alias("o"), F.col("node").alias("pivot"), F.col("n").alias("m"))).alias("p")
    )
    return (
        lists.join(pivots.select("value", "p.pivot", "p.m"), "value")
        .where((F.col("node") != F.col("pivot")) & _sizes_fit("n", "m"))
        .select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))
        .distinct()
    )


def _apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    if comps is None:
        return pairs
    for end in ("u", "v"):
        side = comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(side, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("cu != cv").select("u", "v")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """(left, right) numbers of common values of sorted sets, as products of 0/1 matrices of ``width`` values at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [np.concatenate(x) for x in (left, right)]
    values = np.intersect1d(*flat)
    if not len(values):
        return out
    sides = []
    for x, all_ in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(values, all_), len(values) - 1)
        known = values[at] == all_
        row, at = np.repeat(np.arange(len(x)), [len(s) for s in x])[known], at[known]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for first in range(0, len(values), width):
        cells = []
        for x, (row, at) in zip((left, right), sides, strict=True):
            a, b = np.searchsorted(at, (first, first + width))
            m = np.zeros((len(x), min(width, len(values) - first)), dtype=np.float32)
            m[row[a:b], at[a:b] - first] = 1
            cells.append(m)
        out += cells[0] @ cells[1].T
    return out


def _groups(rows: pd.DataFrame, key: str) -> dict[int, pd.DataFrame]:
    return {k: g for k, g in rows.groupby(key, sort=False)} if len(rows) else {}


def _pairs_frame(pairs) -> pd.DataFrame:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _linker(k: int, shared: int):
    part, whole = SIMILAR

    def similar(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        """(left, right) mask of similar documents in different components: first by sketches, then by full sets."""
        a, b = left["full"].tolist(), right["full"].tolist()
        n, m = (np.array([len(x) for x in side]) for side in (a, b))
        hits = left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        hits &= whole * np.minimum(n[:, None], m[None, :]) >= part * np.maximum(n[:, None], m[None, :])
        least = np.array([least_shared(x, k, shared) for x in n.tolist()])
        hits &= shared_counts([x[:k] for x in a], [x[:k] for x in b]) >= least[:, None]
        x, y = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
        if len(x):
            both = shared_counts([a[i] for i in x.tolist()], [b[j] for j in y.tolist()])
            hits[np.ix_(x, y)] &= whole * both >= part * (n[x][:, None] + m[y][None, :] - both)
        return hits

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Exact links of outside documents with a component's members and with each other.

        Of the component's members the first found is enough to join a document; links
        with documents outside it are all reported.
        """
        found: set[tuple[int, int]] = set()
        members = _groups(right, "target")
        for target, some in _groups(left, "target").items():
            others = members.get(target)
            if others is None:
                continue
            hits = similar(some, others)
            x, y = some["node"].to_numpy(), others["node"].to_numpy()
            inside = others["component"].to_numpy() == target
            within = hits[:, inside]
            for i in np.flatnonzero(within.any(axis=1)).tolist():
                j = y[inside][int(within[i].argmax())]
                found.add((max(x[i], j), min(x[i], j)))
            for i, j in zip(*np.nonzero(hits & ~inside[None, :]), strict=True):
                found.add((max(x[i], y[j]), min(x[i], y[j])))
        return _pairs_frame(found)

    return run


def component_links(minor: DataFrame, where: DataFrame, sets: DataFrame, k: int, shared: int, block: int, values: int) -> DataFrame:
    """Verified links of the documents around large components: with their members, and among each other.

    minor: node, component, target (a component that shares a list with the node);
    where: node, n, component. Sides are dealt to blocks of about ``block`` documents and
    ``values`` shingles, whichever are fewer; small components share buckets of as many shingles.
    """
    tasks = durable(minor.distinct())
    targets = tasks.select("target").distinct()
    inside = where.join(targets, F.col("component") == F.col("target"), "left_semi").withColumn("target", F.col("component"))
    around = tasks.join(where.select("node", "n"), "node")
    sides = inside.select("node", "n", "component", "target").unionByName(around.select("node", "n", "component", "target"))
    outer = F.col("component") != F.col("target")
    parts = lambda rows, size: F.greatest(F.ceil(rows / block), F.ceil(size / values)).cast("int")
    sizes = sides.groupBy("target").agg(
        F.sum("n").alias("size"),
        parts(F.count(F.lit(1)), F.sum("n")).alias("py"),
        parts(F.count_if(outer), F.coalesce(F.sum(F.when(outer, F.col("n"))), F.lit(0))).alias("px"),
    )
    sizes = durable(sizes)
    buckets = max(1, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / values))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    at = F.pmod(F.xxhash64("target"), F.lit(buckets)).cast("int").alias("bucket")
    kept = ("node", "component", "target")
    left = tasks.join(sizes, "target").select(*kept, at, of("px").alias("x"), every("py").alias("y")).join(sets, "node")
    right = sides.join(sizes, "target").select(*kept, at, of("py").alias("y"), every("px").alias("x")).join(sets, "node")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # so that Spark tells the two sides apart
    on = ("bucket", "x", "y")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(_linker(k, shared), "u long, v long").distinct()


def _bucket_pairs(k: int, shared: int, matrix_from: int = 2000):
    """Candidates of all the lists (or blocks of long lists) that share a bucket.

    A pair is reported by the first of the lists that index both, and nowhere else.
    """
    part, whole = SIMILAR

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        sketches: dict[int, frozenset] = {}
        prefixes: dict[int, frozenset] = {}
        for x in (left, right):
            for node, sketch, prefix in x[["node", "sketch", "prefix"]].drop_duplicates("node").itertuples(index=False, name=None):
                if node not in sketches:
                    sketches[node], prefixes[node] = frozenset(sketch.tolist()), frozenset(prefix.tolist())
        others_of = _groups(right, "value")
        for value, some in _groups(left, "value").items():
            others = others_of.get(value)
            if others is None:
                continue
            y = others["node"].to_numpy()
            m, apart = others["n"].to_numpy(), others["component"].to_numpy()
            overlap = None
            if len(some) * len(others) >= matrix_from:
                overlap = shared_counts(some["sketch"].tolist(), others["sketch"].tolist())
            for i, (node, n, component) in enumerate(some[["node", "n", "component"]].itertuples(index=False, name=None)):
                least = least_shared(n, k, shared)
                fits = (apart != component) & (whole * np.minimum(n, m) >= part * np.maximum(n, m))
                if overlap is not None:
                    fits &= overlap[i] >= least
                for other in y[fits].tolist():
                    if min(prefixes[node] & prefixes[other]) == value and may_be_similar(sketches[node], sketches[other], k, shared):
                        found.add((max(node, other), min(node, other)))
        return _pairs_frame(found)

    return run


def listed_pairs(rows: DataFrame, classes: DataFrame, lists: DataFrame, k: int, shared: int, block: int, bucket: int) -> DataFrame:
    """Candidates among the rows (value, node, n, component, seeks, m) of each list; those that seek are held against all.

    Long lists are compared in blocks, short ones gathered to buckets of about ``bucket`` rows.
    """
    buckets = max(1, math.ceil(rows.count() / bucket))
    known = classes.select("node", "sketch").join(lists.groupBy("node").agg(F.collect_list("value").alias("prefix")), "node")
    rows = rows.select(
        "value", "node", "n", "component", "seeks", F.ceil(F.col("m") / block).cast("int").alias("parts"),
        F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int").alias("bucket"),
    ).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(known, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    kept = ("value", "node", "n", "component", "sketch", "prefix")
    left = rows.where("seeks").select("bucket", "part", other.alias("other"), *kept)
    right = rows.select(  # aliases, so that Spark tells the two sides apart
        F.col("bucket").alias("bucket"), other.alias("part"), F.col("part").alias("other"), *[F.col(c).alias(c) for c in kept]
    )
    on = ("bucket", "part", "other")
    return (
        left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(_bucket_pairs(k, shared), "u long, v long").distinct()
    )


def remaining_links(
    lists: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, k: int, shared: int,
    block: int = BLOCK, values: int = BLOCK_VALUES, large: int = 8, bucket: int = 4_000,
) -> DataFrame:
    """Verified links in lists with members in several components.

    Members of a list's largest component need no comparison with each other. If
    that component has ``large`` members or more, all documents that share a list
    with it are held against it and each other, once, by their full sets; else the
    list's other documents are held against the whole list.
    """
    nodes = lists.select("node", "n").distinct().join(comps, "node", "left")
    where = durable(nodes.withColumn("component", F.coalesce("component", "node")))
    sizes = where.groupBy("component").agg(F.count(F.lit(1)).alias("target_m")).withColumnRenamed("component", "target")
    members = lists.join(where.drop("n"), "node")
    counts = members.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    split = counts.groupBy("value").agg(
        F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("n_components")
    )
    split = split.where("n_components > 1").select("value", "m", F.col("most.component").alias("target")).join(sizes, "target")
    rows = durable(members.join(split, "value").withColumn("seeks", F.col("component") != F.col("target")))
    minor = rows.where(F.col("seeks") & (F.col("target_m") >= large)).select("node", "component", "target")
    first = durable(component_links(minor, where, sets, k, shared, block, values))
    candidates = listed_pairs(rows.where(F.col("target_m") < large), classes, lists, k, shared, block // 4, bucket)
    return first.unionByName(verified(durable(candidates), sets, k, shared))


def near_duplicates(docs: DataFrame, width: int = 5, k: int = SKETCH, shared: int = SHARED, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = durable(
        texts.mapInArrow(_sketches(width, k), "doc_id long, text_hash long, n_shingles long, set_key binary, sketch array<long>")
    )
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")  # the row whose text stands for the class
    classes = durable(
        rows.where(F.col("set_key").isNotNull())
        .groupBy("set_key")
        .agg(F.min(least).alias("r"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .select("set_key", "n", "sketch", "r.doc_id", "r.text_hash", F.when(F.col("n") > 0, F.monotonically_increasing_id()).alias("node"))
    )
    lists = durable(inverted_lists(classes, k, shared))
    wanted = lists.select("node").distinct().join(classes, "node").select(
        "node", "set_key", F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash")
    )
    found = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash"))
    sets = durable(
        texts.join(wanted.hint("shuffle_hash"), found)
        .select("node", "set_key", "text")
        .mapInArrow(_full_sets(width), "node long, full array<long>")
    )
    pending = durable(pivot_pairs(lists))
    comps = None
    for turn in range(rounds):
        todo = pending
        if turn < rounds - 1:  # two pivots for each document first; what they link needs no more
            order = F.struct(F.xxhash64("u", "v", F.lit(turn)).alias("o"), "v")
            ends = pending.groupBy("u").agg(F.min(order).alias("a"), F.max(order).alias("b"))
            todo = ends.select("u", F.explode(F.array_distinct(F.array("a.v", "b.v"))).alias("v"))
        todo = durable(todo)
        found = durable(verified(todo, sets, k, shared))
        comps = durable(components(found) if comps is None else joined_components(comps, found))
        pending = durable(_apart(pending.join(todo, ["u", "v"], "left_anti"), comps))
        if pending.isEmpty():
            break
    late = durable(remaining_links(lists, comps, classes, sets, k, shared))
    if not late.isEmpty():
        comps = durable(joined_components(comps, late))
    labels = classes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = labels.select("set_key", "component").join(ids, "component").select("set_key", "component_id")
    found = rows.join(by_set, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of smallest doc_id.

    Rows without words stay. Where doc_ids are null or repeat, rows are compared
    by keys of their own, dealt in the order of doc_id with null last.
    """
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        kept = durable(near_duplicates(rows, width).where("kept").select("doc_id"))
        return rows.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    # The hash deals a hot doc_id (or null) to several ranges; the ids follow the ranges.
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    keyed = durable(rows.orderBy(*order).withColumn("row_key", F.monotonically_increasing_id()))
    found = near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"), width)
    kept = durable(found.where("kept").select(F.col("doc_id").alias("row_key")))
    return keyed.join(kept.hint("shuffle_hash"), "row_key", "left_semi").select(*rows.columns)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


QUERIES = {"op5_neardup": op5_neardup}
