"""Operators on vectors: centroids, prototypes, assignment, pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine
from tidemark.operators.graph import components


def centroids(vectors: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector of each key, by position; partial sums are combined before the shuffle."""
    by_place = vectors.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    return by_place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(
        *keys, F.transform("p", lambda s: s["x"]).alias("vec")
    )


def nearest_prototype(items: DataFrame, prototypes: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """Best prototype of the item's kind, its own one's similarity, and ``flagged`` if another beats it by more than ``margin``.

    items: item, label, vec and keys; prototypes (few): proto, vec and keys.
    Kinds with fewer than two prototypes take no part.
    """
    many = prototypes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    protos = prototypes.join(many, keys, "left_semi").withColumnRenamed("vec", "p_vec")
    sim = F.round(cosine(F.col("vec"), F.col("p_vec")), 6)
    scored = items.join(protos, keys).select("item", "label", "proto", sim.alias("sim"))
    best = F.max(F.struct("sim", (-F.col("proto")).alias("p")))
    out = scored.groupBy("item", "label").agg(
        best.alias("b"), F.max(F.when(F.col("proto") == F.col("label"), F.col("sim"))).alias("own_sim")
    )
    flagged = (-F.col("b.p") != F.col("label")) & (F.col("b.sim") - F.col("own_sim") > margin)
    return out.select(
        "item", "label", (-F.col("b.p")).alias("best"), F.col("b.sim").alias("best_sim"), "own_sim",
        F.coalesce(flagged, F.lit(False)).alias("flagged"),
    )


def candidate_scores(items: DataFrame, candidates: DataFrame, broadcast_rows: int = 1000, blocks: int = 64) -> DataFrame:
    """item, candidate, sim of every item (item, embedding) with every candidate (candidate, c_vec).

    Candidates are broadcast while there are at most ``broadcast_rows``; beyond
    that each item is sent to every one of ``blocks`` blocks of candidates.
    """
    sim = F.round(cosine(F.col("embedding"), F.col("c_vec")), 6).alias("sim")
    if candidates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return items.crossJoin(F.broadcast(candidates)).select("item", "candidate", sim)
    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("candidate"), F.lit(blocks)).cast("int"))
    sent = items.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(dealt.hint("merge"), "block").select("item", "candidate", sim)


def closed_set(scores: DataFrame, floor: float, margin: float) -> DataFrame:
    """Best candidate of each item unless it is below ``floor`` or less than ``margin`` above the second.

    scores: item, candidate, sim.
    """
    order = Window.partitionBy("item").orderBy(F.desc("sim"), "candidate")
    ranked = scores.withColumn("r", F.row_number().over(order)).where("r <= 2")
    two = ranked.groupBy("item").agg(
        F.max(F.when(F.col("r") == 1, F.col("candidate"))).alias("candidate"),
        F.max(F.when(F.col("r") == 1, F.col("sim"))).alias("sim"),
        F.max(F.when(F.col("r") == 2, F.col("sim"))).alias("second"),
    )
    outcome = (
        F.when(F.col("sim") < floor, "below_floor")
        .when(F.col("second").isNull(), "only_candidate")
        .when(F.col("sim") - F.col("second") < margin, "ambiguous")
        .otherwise("assigned")
    )
    return two.withColumn("outcome", outcome)


def _blocked(items: DataFrame, keys: list[str], item: str, vec: str, judge, shape: str, cosines: bool, deal: str | None, block: int) -> DataFrame:
    """keys and what ``judge(a, b, sim, same)`` finds (columns of ``shape``) in stretches of the pairs of each key's items.

    A key's items are dealt to blocks (by a hash of ``deal``), and two blocks are a task, which compares them as matrices, a
    few hundred rows at a time. ``sim`` has the rounded similarities of items ``a`` and ``b``; in a block that meets itself (``same``) each pair comes twice.
    """
    rows = items.where(F.col(vec).isNotNull()).select(*keys, F.col(item).alias("_i"), F.col(vec).alias("_v"), F.xxhash64(deal or item).alias("_d"))
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    rows = rows.join(counts, keys).withColumn("_x", F.pmod("_d", F.col("_nb")).cast("int"))
    cells = rows.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).withColumns({"_a": F.least("_x", "_y"), "_b": F.greatest("_x", "_y")})
    names = [part.split()[0] for part in shape.split(", ")]

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = (cell[cell["_x"] == cell[c].iloc[0]] for c in ("_a", "_b"))
        out = []
        if len(left) and len(right):
            (a, x), (b, y) = ((side["_i"].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in side["_v"]])) for side in (left, right))
            lengths = [np.sqrt((z * z).sum(axis=1)) for z in (x, y)]
            for at in range(0, len(a), 512):
                some = slice(at, at + 512)
                sim = x[some] @ y.T
                if cosines:
                    size = lengths[0][some, None] * lengths[1][None, :]
                    sim = np.where(size == 0, 0.0, sim / np.where(size == 0, 1.0, size))
                out.append(pd.DataFrame(dict(zip(names, judge(a[some], b, np.round(sim, 6) + 0.0, cell["_a"].iloc[0] == cell["_b"].iloc[0]), strict=True))))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({n: [] for n in names})
        for k in keys:
            found[k] = cell[k].iloc[0] if len(found) else cell[k].iloc[:0]
        return found[[*keys, *names]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys).schema)
    return cells.groupBy(*keys, "_a", "_b").applyInPandas(compare, f"{schema}, {shape}")


def pairs_within(items: DataFrame, keys: list[str], item: str, vec: str, threshold: float, block: int = 4096) -> DataFrame:
    """Unordered pairs of equal ``keys`` with cosine of ``threshold`` or more.

    The work is quadratic in a key's items by the operator's meaning: use it on rosters and prototypes.
    """
    kind = items.schema[item].dataType.simpleString()

    def judge(a, b, sim, same):
        near = ~(sim < threshold)
        near &= np.less.outer(a, b) if same else np.not_equal.outer(a, b)
        i, j = np.nonzero(near)
        return np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), sim[i, j]

    return _blocked(items, keys, item, vec, judge, f"left {kind}, right {kind}, sim double", True, None, block)


def nearest_earlier(items: DataFrame, keys: list[str], item: str, vec: str, block: int = 4096) -> DataFrame:
    """item, sim: the best cosine of each item with those before it of equal ``keys``; items without any are left out.

    No pair leaves its task; a block sends one row an item.
    """
    kind = items.schema[item].dataType.simpleString()

    def judge(a, b, sim, same):
        found = []
        for ours, before, s in ((b, np.less.outer(a, b), sim.T),) if same else ((b, np.less.outer(a, b), sim.T), (a, np.greater.outer(a, b).T, sim)):
            before = before.T
            some = before.any(axis=1)
            found.append((ours[some], np.where(before, s, -np.inf)[some].max(axis=1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    rows = _blocked(items, keys, item, vec, judge, f"_item {kind}, sim double", True, None, block)
    return rows.groupBy(F.col("_item").alias(item)).agg(F.max("sim").alias("sim"))


def best_between(items: DataFrame, keys: list[str], side: str, vec: str, deal: str, block: int = 4096) -> DataFrame:
    """keys, side_a, side_b, best, n: the best inner product of the items of every two sides (side_a < side_b), and their number of pairs.

    ``deal`` is the column by which items are dealt to blocks.
    """
    kind = items.schema[side].dataType.simpleString()

    def judge(a, b, sim, same):
        found = []
        for p in np.unique(a):
            for q in np.unique(b):
                if p < q or (p > q and not same):
                    cut = sim[np.ix_(a == p, b == q)]
                    found.append((min(p, q), max(p, q), cut.max(), cut.size))
        return tuple(zip(*found, strict=True)) or ((), (), (), ())

    rows = _blocked(items, keys, side, vec, judge, f"side_a {kind}, side_b {kind}, sim double, pairs long", False, deal, block)
    return rows.groupBy(*keys, "side_a", "side_b").agg(F.max("sim").alias("best"), F.sum("pairs").alias("n"))


def dispersion(items: DataFrame, keys: list[str], item: str, vec: str) -> DataFrame:
    """Least cosine over the pairs of each key; null for a single item. A task sends the least of every few hundred rows."""

    def judge(a, b, sim, same):
        pick = np.less.outer(a, b) if same else np.not_equal.outer(a, b)
        return ([np.fmin.reduce(sim[pick])] if pick.any() else [],)

    least = _blocked(items, keys, item, vec, judge, "sim double", True, None, 4096).groupBy(*keys).agg(F.min("sim").alias("dispersion"))
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(least, keys, "left")


def compatible(a: Column, b: Column, share: float) -> Column:
    """Static attributes (maps) agree on at least ``share`` of their common keys; nothing in common is compatible."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    equal = F.filter(common, lambda k: F.lower(F.element_at(a, k)) == F.lower(F.element_at(b, k)))
    return F.when(F.size(common) <= 0, F.lit(True)).otherwise(F.size(equal) / F.size(common) >= share)


def label_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (u, v), by alternating stars until they are stable; component is its smallest node."""
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    found = components(edges)
    return found.unionByName(alone.join(found, "node", "left_anti"))


def merge_survivors(members: DataFrame, weight: str) -> DataFrame:
    """Survivor of each component: the member of largest weight, of equals the largest id."""
    return members.groupBy("component").agg(
        F.max(F.struct(weight, "node")).alias("b"), F.count(F.lit(1)).alias("n_members")
    ).select("component", F.col("b.node").alias("survivor"), "n_members")
