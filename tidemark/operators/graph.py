"""Connected components: stars within parts of an edge table, then alternating star operations between the parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.checkpoints import durable

#: Edges that a task joins to stars by itself; a part of the edge table holds about as many.
PART = 1 << 20


def star_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node of the edges to the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _stars(part: int):
    """Stars of the edges of a task, ``part`` edges at a time and those found before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += len(batch)
            if n < part:
                continue
            u, v = star_links(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [(u, v)], len(u)
            if 2 * n > part:  # hardly smaller: the rounds between parts take it from here
                yield out(u, v)
                held, n = [], 0
        if n:
            yield out(*star_links(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour; a link may come more than once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are linked to the smallest of them. Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges are stars: no node is linked to two smaller ones, or to smaller and larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    sums = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where("below > 1 or (below > 0 and above > 0)").count() == 0


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """(node, component) for every node of the long pairs (u, v); component is its smallest node.

    Parts of about ``part`` edges become stars in a task each. Where there are
    several parts, stars converge in a logarithmic number of rounds: a round's rows
    never outnumber the edges, and hot centres are met by joins and minima that Spark
    can split or combine early.
    """
    # Spark's checkpoints break on unions of columns of which only one can be null, so here both can.
    whole = F.col("u").isNotNull() & F.col("v").isNotNull()
    ends = edges.select(F.when(whole, F.greatest("u", "v")).alias("u"), F.when(whole, F.least("u", "v")).alias("v"))
    now = durable(ends.where("u > v"))
    n = now.count()
    parts = max(1, -(-n // part))
    now = durable(now.coalesce(parts).mapInArrow(_stars(max(part, 2)), "u long, v long"))
    if n >= part:  # below that, one task saw all edges at once
        now = durable(now.distinct())
        while not _settled(now):
            now = durable(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` (node, component) after more ``links`` (u, v): only the components that these join are walked."""
    ends = links
    for end in ("u", "v"):
        side = found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(side, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    merged = durable(components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
    tops = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = found.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return old.unionByName(merged.join(found.select("node"), "node", "left_anti"))
