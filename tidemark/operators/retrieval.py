"""Causal rankers: dense, lexical, recency, random, fusion and budget cuts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot

K1, B = 1.5, 0.75
RRF_K = 60
TOKEN = r"[A-Za-z0-9一-鿿]+"
#: What rank costs a hit when segments are opened into frames.
RANK_STEP = 1e-6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def top(hits: DataFrame, query: list[str], score: str, ties: str, k: int) -> DataFrame:
    """The k best hits of each query (a group limit runs before the shuffle)."""
    order = Window.partitionBy(*query).orderBy(F.desc(score), ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, places: int = 6) -> DataFrame:
    """query, item, score (plain product of vectors ``q_vec`` and ``vec``) of the k best items within equal ``keys``.

    With ``as_of`` on the query side, only items whose ``ends`` is at or before it count.
    """
    pairs = queries.join(corpus, keys)
    if "as_of" in queries.columns:
        pairs = pairs.where(F.col("ends") <= F.col("as_of"))
    scored = pairs.withColumn("score", F.round(dot(F.col("q_vec"), F.col("vec")), places))
    return top(scored.select("query", "item", "score"), ["query"], "score", "item", k)


def bm25(queries: DataFrame, corpus: DataFrame, k: int, places: int = 6, cells: int = 4_000_000) -> DataFrame:
    """Lexical top k over a whole corpus. queries: query, text; corpus: item, text.

    Repeated query tokens count each time; only positive scores are returned.
    While queries times their distinct tokens are at most ``cells``, the query side
    is sent to every task as a matrix of weights: documents are scored where they
    lie, and only each task's best k of a query are shuffled. Beyond that, term
    counts of query tokens are joined by token.
    """
    asked = (
        queries.select("query", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("query", "token").agg(F.count(F.lit(1)).alias("qtf"))
    )
    n_queries, n_tokens = asked.agg(F.count_distinct("query"), F.count_distinct("token")).first()
    words = corpus.select("item", tokens(F.col("text")).alias("t"))
    whole = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("t")).alias("avg_len"))  # one row
    if not n_queries or n_queries * n_tokens > cells:
        return _bm25_joined(asked, words, whole, k, places)
    wanted = F.broadcast(asked.select("token").distinct())  # at most ``cells`` rows
    df = words.select(F.explode(F.array_distinct("t")).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = asked.join(df, "token").collect()  # at most ``cells`` rows
    n_docs, avg_len = whole.first()
    scored = words.mapInPandas(_scorer(rows, n_docs, avg_len, k, places), f"query {_kind(queries, 'query')}, item {_kind(corpus, 'item')}, score double")
    return top(scored, ["query"], "score", "item", k)


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _scorer(rows: list, n_docs: int, avg_len: float, k: int, places: int):
    """Best items of each query in a batch of documents (item, t: its tokens)."""
    names = sorted({r.query for r in rows})
    place = {q: i for i, q in enumerate(names)}
    column = {t: i for i, t in enumerate(sorted({r.token for r in rows}))}
    weights = np.zeros((len(column), len(names)))
    for r in rows:
        weights[column[r.token], place[r.query]] = math.log(1 + (n_docs - r.df + 0.5) / (r.df + 0.5)) * r.qtf

    def best(items: np.ndarray, docs: list) -> Iterator[pd.DataFrame]:
        scores = np.zeros((len(items), len(names)))
        for i, words in enumerate(docs):
            found = [column[w] for w in words if w in column]
            if found:
                at, tf = np.unique(np.array(found), return_counts=True)
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / avg_len))
                scores[i] = gain @ weights[at]
        scores = np.round(scores, places)
        for q, name in enumerate(names):
            own = scores[:, q]
            some = np.flatnonzero(own > 0)
            if len(some) > k:
                edge = np.partition(own[some], len(some) - k)[len(some) - k]
                some = some[own[some] >= edge]
            some = some[np.lexsort((items[some], -own[some]))[:k]]
            if len(some):
                yield pd.DataFrame({"query": [name] * len(some), "item": items[some], "score": own[some]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 2048):
                part = frame.iloc[a : a + 2048]
                parts = list(best(part["item"].to_numpy(), [t if t is not None else () for t in part["t"]]))
                if parts:
                    yield pd.concat(parts)

    return run


def _bm25_joined(asked: DataFrame, words: DataFrame, whole: DataFrame, k: int, places: int) -> DataFrame:
    """The same by joins on the token, for query sides of any size."""
    tf = (
        words.select("item", F.size("t").alias("len"), F.explode("t").alias("token"))
        .join(asked.select("token").distinct(), "token", "left_semi")
        .groupBy("item", "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n, d = F.col("n_docs"), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weights = asked.join(df, "token").join(F.broadcast(whole)).withColumn("w", idf * F.col("qtf"))
    scored = (
        tf.join(weights.select("query", "token", "w", "avg_len"), "token")
        .groupBy("query", "item").agg(F.round(F.sum(F.col("w") * gain), places).alias("score"))
        .where("score > 0")
    )
    return top(scored, ["query"], "score", "item", k)


def causal_bm25(turns: DataFrame, k: int, places: int = 6) -> DataFrame:
    """Each turn's k best earlier turns of its own story, with statistics of that history only.

    turns: story, idx, text. Term statistics of a history are running sums over
    the story; no pair is made that shares no token.
    """
    words = turns.select("story", "idx", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    before = Window.partitionBy("story").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    history = words.select(
        "story", "idx", F.count(F.lit(1)).over(before).alias("n_docs"), F.avg("len").over(before).alias("avg_len")
    )
    tf = (
        words.select("story", "idx", "len", F.explode("t").alias("token"))
        .groupBy("story", "idx", "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    )
    seen = Window.partitionBy("story", "token").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    asked = tf.select(
        "story", "token", F.col("idx").alias("q_idx"), F.col("tf").alias("qtf"), F.count(F.lit(1)).over(seen).alias("df")
    ).where("df > 0")
    pairs = asked.join(tf, ["story", "token"]).where(F.col("idx") < F.col("q_idx"))
    pairs = pairs.join(history.withColumnRenamed("idx", "q_idx"), ["story", "q_idx"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = pairs.groupBy("story", "q_idx", "idx").agg(F.round(F.sum(idf * F.col("qtf") * gain), places).alias("score"))
    return top(scored.where("score > 0"), ["story", "q_idx"], "score", "idx", k)


def recency(turns: DataFrame, k: int) -> DataFrame:
    """The k turns just before each turn, newest first, scored 1/rank."""
    span = F.explode(F.sequence(F.lit(1), F.lit(k)))
    asked = turns.select("story", F.col("idx").alias("q_idx"), span.alias("rank")).withColumn("idx", F.col("q_idx") - F.col("rank"))
    return asked.join(turns.select("story", "idx"), ["story", "idx"]).withColumn("score", F.round(1.0 / F.col("rank"), 6))


def random_order(items: DataFrame, query: list[str], item: str, k: int, seed: str) -> DataFrame:
    """k items of each query in an order given by a keyed hash; runs and engines agree."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in [*query, item]]), 256)
    order = Window.partitionBy(*query).orderBy(key, item)
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], query: list[str], item: str, k: int) -> DataFrame:
    """Reciprocal rank fusion; ties go to what was met first (earlier list, better rank)."""
    parts = [r.select(*query, item, "rank", F.lit(n).alias("list")) for n, r in enumerate(rankings)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scored = union.groupBy(*query, item).agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("met")
    )
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "met", item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("met")


def open_segments(segments: DataFrame, query: list[str], frames: Column, k: int) -> DataFrame:
    """Frames of ranked segments, rescored by segment score less a step for each rank; the k best.

    ``segments`` has rank and score; ``frames`` is an array of times.
    """
    opened = segments.select(*query, "rank", "score", F.posexplode(frames).alias("frame_rank", "seconds"))
    rescored = opened.withColumn(
        "frame_score", F.round(F.col("score") - RANK_STEP * (F.col("rank") + F.col("frame_rank")), 9)
    )
    order = Window.partitionBy(*query).orderBy(F.desc("frame_score"), "rank", "frame_rank")
    return rescored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def keyframe_hits(hits: DataFrame, keyframes: DataFrame, query: list[str], budget: int, places: int = 9) -> DataFrame:
    """query, item, score, place: key frames of ranked segments, by segment score less a step for each rank.

    hits: query, seg, rank, score; keyframes: seg, item, pick (0 is the segment's first).
    """
    opened = hits.join(keyframes, "seg")
    score = F.round(F.col("score") - RANK_STEP * (F.col("rank") + F.col("pick") + 1), places)
    order = Window.partitionBy(*query).orderBy(F.desc("frame_score"), "rank", "pick")
    rows = opened.withColumn("frame_score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)
    return rows.select(*query, "item", F.col("frame_score").alias("score"), "place")


def coarse_to_fine(queries: DataFrame, hits: DataFrame, frames: DataFrame, budget: int, places: int = 6) -> DataFrame:
    """query, item, score, rank: frames of ranked segments, by their segment's rank and by their own likeness, fused.

    queries: query, q_vec; hits: query, seg, rank; frames: seg, item, vec. The fine
    list keeps four times the budget.
    """
    opened = hits.select("query", "seg", F.col("rank").alias("seg_rank")).join(frames, "seg").join(queries, "query")
    rows = opened.select("query", "item", "seg_rank", F.round(dot(F.col("q_vec"), F.col("vec")), places).alias("own"))
    by = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    coarse = rows.withColumn("rank", by("seg_rank", "item"))
    fine = rows.withColumn("rank", by(F.desc("own"), "seg_rank", "item")).where(F.col("rank") <= 4 * budget)
    return fuse([coarse, fine], ["query"], "item", budget)


def planned_sources(plans: DataFrame, plan: str, budget: int) -> DataFrame:
    """First ``budget`` planned shots without repeats, and the shot before the segment where there is room."""
    kept = F.array_distinct(F.slice(plan, 1, budget))
    filler = F.when(
        (F.size(kept) < budget) & (F.col("idx") > 0) & ~F.array_contains(kept, F.col("idx") - 1), F.array(F.col("idx") - 1)
    ).otherwise(F.slice(kept, 1, 0))
    return plans.withColumn("sources", F.concat(kept, filler))
