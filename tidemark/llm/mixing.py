"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (operator 1).

Sizes are counted in words. Sources sorted by code point (null last) have the
weights in turn and share ``total_share`` of all words; no target exceeds
``most_repeats`` times its source's words, and what is cut off is shared out again
by weight (the shares that result are min(limit, level * weight) for one level,
found from sorted ratios).

A source is cut into blocks of about ``block_words`` words by a hash of doc_id, and
its blocks are put in a permuted order. The target is a number of full passes over
them and a last part of the order; its last block ends at the very word. All blocks
to be drawn are then dealt to output shards: the root of a binary tree has the
number of blocks of each source, and each node splits its quotas exactly between
its halves by a multivariate hypergeometric draw, seeded by the node. A leaf is a
shard; it gets a run of each source's permuted blocks that no other shard gets, and
shuffles its documents by a keyed hash. Every leaf can be found from the root
alone, so shards are dealt in parallel and a lost one is dealt again alike.

Edge cases: null or empty texts have no words and are taken 0 times; an all-empty
source has target 0; rows without a doc_id hash by their text; repeated rows are rows of their
own; a null source is a source; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, durable, hand_back

WEIGHTS = (5.0, 2.0, 1.0)
CHUNK = 4096
STEP = (1 << 31) - 1  # a prime above any number of blocks


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, total_share: float = 1.5, most_repeats: float = 2.0
) -> DataFrame:
    """source, place (from 0), source_size, target: one row for each source.

    With a column ``lang`` in ``sizes``, it is returned too and each language of a source is a pool of its own, with its source's weight.
    """
    pool = [c for c in ("source", "lang") if c in sizes.columns]
    sources = sizes.groupBy(*pool).agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(*[x for c in pool for x in (F.col(c).isNull(), F.col(c))])  # one row a pool
    of_source = Window.orderBy(F.col("source").isNull(), "source")
    placed = sources.withColumns({"place": (F.row_number().over(ordered) - 1).cast("int"), "turn": F.dense_rank().over(of_source) - 1})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    rated = placed.withColumn("weight", weight).withColumn("most", most_repeats * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        (total_share * F.sum("source_size").over(whole))
        - (F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    ) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # The first source in this order whose level stays below its ratio sets the level of all after it.
    levels = rated.withColumn("level", level).withColumn(
        "fits", F.col("level") * F.col("weight") <= F.col("most")
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole)
    common = levels.withColumn("common", first["level"])
    return common.select(
        *pool, "place", "source_size",
        F.least("most", F.coalesce(F.col("common") * F.col("weight"), "most")).alias("target"),
    )


def _permuted(block, n):
    """An order of ``n`` blocks that neighbours don't share: multiplication by a prime, modulo n."""
    return F.pmod(block * F.lit(STEP) + F.lit(STEP // 3), n)


def _split(quotas: np.ndarray, left: int, seed: list[int]) -> np.ndarray:
    return np.random.default_rng(seed).multivariate_hypergeometric(quotas, left, method="marginals")


def dealt(quotas: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, quota) with an entry a source, for shards ``first`` to ``last`` - 1."""

    def walk(lo: int, hi: int, at: np.ndarray, have: np.ndarray):
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, at, have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        goes = _split(have, total * (mid - lo) // (hi - lo), [seed, lo, hi])
        yield from walk(lo, mid, at, goes)
        yield from walk(mid, hi, at + goes, have - goes)

    yield from walk(0, shards, np.zeros_like(quotas), quotas)


def _dealer(quotas: list[int], shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out: list[list[int]] = [[], [], [], []]
            runs = np.split(ids, np.flatnonzero(np.diff(ids) != 1) + 1) if len(ids) else []
            for some in runs:
                for shard, start, quota in dealt(np.array(quotas, dtype=np.int64), shards, int(some[0]), int(some[-1]) + 1, seed):
                    for place in np.flatnonzero(quota).tolist():
                        for column, v in zip(out, (shard, place, int(start[place]), int(quota[place])), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                names=["shard", "place", "start", "quota"],
            )

    return run


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    total_share: float = 1.5,
    most_repeats: float = 2.0,
    block_words: int = 1 << 15,
    shard_blocks: int = 64,
    seed: int = 5,
    keep: tuple[str, ...] = ("doc_id",),
    broadcast_sources: int = 100_000,
    by_language: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with columns ``keep``, size, source_size, target, taken and draws.

    With ``by_language``, what is said of sources holds for each language (column ``lang``)
    of a source: it weighs as its source does and has a size and a target of its own.

    ``draws`` has an entry for each time the row is drawn: its shard, its place
    there (shards sort by it) and the words taken (all, or the first ones of the
    row where a source's target ends).
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Rows of one id, or of none, are told apart by their texts: they don't share a block, and their order is the same in every run.
    salt = F.xxhash64("text").alias("salt")
    pool = ("source", "lang") if by_language else ("source",)
    sized = docs.select(*keep, *[F.col(c).cast("string").alias(c) for c in pool], words.alias("size"), salt)
    sized = durable(sized)
    targets = durable(source_targets(sized, weights, total_share, most_repeats))
    n_sources = targets.count()
    few = n_sources <= broadcast_sources
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    plan = targets.select(
        *[F.col(c).alias(f"from_{c}") for c in pool], "place", "source_size", "target", blocks_of.alias("n_blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
    ).withColumn("rest", (F.round("target") - F.col("passes") * F.col("source_size")).cast("long"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"from_{c}")) for c in pool])
    rows = sized.join(F.broadcast(plan) if few else plan, same).drop(*[f"from_{c}" for c in pool])
    h = F.xxhash64(F.col("doc_id"), F.col("salt"), F.lit(seed))
    rows = rows.withColumns({"h": h, "block": _permuted(F.pmod(h, F.col("n_blocks")), F.col("n_blocks"))})

    # Words before each block in its source's order: within chunks of blocks, and chunks before.
    blocks = durable(
        rows.groupBy("place", "block", "n_blocks", "passes", "rest").agg(F.sum("size").alias("words"))
        .withColumn("chunk", (F.col("block") / CHUNK).cast("long"))
    )
    inside = Window.partitionBy("place", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    chunks = blocks.groupBy("place", "chunk").agg(F.sum("words").alias("sum")).withColumn(
        "before", F.sum("sum").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")
    )
    cut = (
        blocks.join(chunks.drop("sum"), ["place", "chunk"])
        .withColumn("before", F.col("before") + F.sum("words").over(inside) - F.col("words"))
        .withColumn("more", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
        .select("place", "block", "n_blocks", "passes", "words", "more")
    )
    cut = durable(cut)

    # What the tree deals: a source's full passes, block by block, and then the blocks of its last part.
    asked = cut.groupBy("place").agg(
        F.max(F.col("n_blocks") * F.col("passes")).alias("full"),
        F.coalesce(F.max(F.when(F.col("more") > 0, F.col("block") + 1)), F.lit(0)).alias("part"),
    )
    quotas = [0] * n_sources  # one number a source
    for r in asked.collect():
        quotas[r.place] = r.full + r.part
    total = sum(quotas)
    shards = max(1, -(-total // shard_blocks))
    spark = docs.sparkSession
    leaves = spark.range(0, shards, 1, max(1, min(shards // 256, 4096))).mapInArrow(
        _dealer(quotas, shards, seed), "shard long, place int, start long, quota long"
    )
    drawn = leaves.select("place", "shard", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("turn"))
    turns = cut.select(
        "place", "block", "words", "more",
        F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))).alias("pass"), "n_blocks", "passes",
    ).where((F.col("pass") < F.col("passes")) | (F.col("more") > 0))
    by_block = (
        turns.withColumn("turn", F.col("pass") * F.col("n_blocks") + F.col("block"))
        .join(drawn, ["place", "turn"])
        .groupBy("place", "block")
        .agg(
            F.collect_list(  # most_repeats entries, and one
                F.struct("pass", "shard", F.when(F.col("pass") < F.col("passes"), F.lit(None)).otherwise(F.col("more")).alias("more"))
            ).alias("turns"),
            F.max(F.when(F.col("pass") == F.col("passes"), F.col("more") - F.col("words"))).alias("short"),
        )
    )
    rows = rows.join(by_block, ["place", "block"], "left")
    # Only the block in which a source's target ends needs the words before each of its rows.
    ends = F.coalesce(F.col("short") < 0, F.lit(False))
    in_block = Window.partitionBy("place", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    split = rows.where(ends).withColumn("upto", F.sum("size").over(in_block))
    rows = rows.where(~ends).withColumn("upto", F.lit(None).cast("long")).unionByName(split)

    def taken(t):
        last = F.greatest(F.lit(0), F.least(F.col("size"), t["more"] - F.col("upto") + F.col("size")))
        whole = t["more"].isNull() | F.col("upto").isNull()
        return F.when(whole, F.col("size")).otherwise(last).cast("long")

    draws = F.transform(
        F.coalesce("turns", F.array().cast("array<struct<pass:int,shard:bigint,more:bigint>>")),
        lambda t: F.struct(
            t["shard"].alias("shard"),
            F.xxhash64("h", t["pass"], t["shard"]).alias("order"),
            taken(t).alias("words"),
        ),
    )
    draws = F.array_sort(F.filter(draws, lambda d: d["words"] > 0))
    out = rows.withColumn("draws", draws)
    return out.select(
        *keep, "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws",
    )


_WORD = re.compile(WORD)


def _first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for m in itertools.islice(_WORD.finditer(text), n):
        end = m.end()
    return text[:end]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of which only the first words are taken are cut, and counted anew."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        partial = np.flatnonzero(np.asarray(columns["words"]) < np.asarray(columns["size"]))
        if len(partial):
            texts, counts = columns["text"].to_pylist(), columns["n_chars"].to_pylist()
            for i in partial.tolist():
                texts[i] = _first_words(texts[i], columns["words"][i].as_py())
                counts[i] = len(texts[i])
            columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array(counts, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)
    batch = columns = texts = counts = None
    hand_back()


def mixed_documents(docs: DataFrame, by_language: bool = False, **options) -> DataFrame:
    """The mix itself: a row for each draw, in its shard's order, its text cut to the words taken.

    Plan and texts meet by doc_id, text and source (and lang, if the mix is ``by_language``);
    rows that share them are alike, and their draws are dealt to them one to one.
    """
    names = ("doc_id", "text", "lang", "source", "n_chars")
    marks = {"text_hash": F.xxhash64("text"), "its_source": F.col("source").cast("string")}
    keys = ("doc_id", "text_hash", "its_source")
    if by_language:
        marks["its_lang"] = F.col("lang").cast("string")
        keys = (*keys, "its_lang")
    base = docs.select("doc_id", "text", "lang", "source").withColumns(marks)
    plan = durable(mix(base, keep=keys, by_language=by_language, **options).select(*keys, "size", "draws"))
    texts = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).withColumns(marks)
    first = F.lit(0)
    if not plan.groupBy(*keys).count().where("count > 1").isEmpty():
        own = Window.partitionBy(*keys)
        plan = plan.withColumn("alike", F.row_number().over(own.orderBy(F.to_json("draws"))))
        first = F.row_number().over(own.orderBy("lang", "n_chars"))
    else:
        plan = plan.withColumn("alike", F.lit(0))
    texts = texts.withColumn("alike", first)
    drawn = plan.where(F.size("draws") > 0).select(
        *[F.col(k).alias(f"drawn_{k}") for k in (*keys, "alike")], "size", F.explode("draws").alias("d")
    )
    same = F.col("alike") == F.col("drawn_alike")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"drawn_{k}"))
    rows = texts.join(drawn.hint("shuffle_hash"), same).select(*names, "size", "d.words", "d.shard", "d.order")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.sortWithinPartitions("shard", "order").mapInArrow(_cut, schema).select(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.to_json("draws").alias("draws"))


QUERIES = {"op1_mixing": op1_mixing}
