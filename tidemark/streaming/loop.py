"""The closed loop of a story: select references, check that they lie in the past, realise, observe.

A policy answers from what it has observed, a realiser makes a segment and may fail. A failed
segment is recorded and not observed; after ``most_failures`` in a row the story is given
up and has no further records. State of a story is what the policy keeps, its last
segment and its failures, so a stream that stops goes on from its checkpoint as if it had never
stopped. A run can also be taken up from the records of another: its closed prefix (segments 0, 1, ... without
a failure) is observed again and not realised.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "story long, idx long, status string, sources string, result string, error string, resumed boolean"


class Policy(Protocol):
    """Memory of one story; all it knows must be in ``state``, which is kept as JSON."""

    def start(self) -> Any: ...

    def select(self, state: Any, idx: int, prompt: str) -> list[int]: ...

    def observe(self, state: Any, idx: int, prompt: str, result: str) -> Any: ...


class Realiser(Protocol):
    def realise(self, story: int, idx: int, prompt: str, sources: list[int]) -> str: ...


class Newest:
    """The newest ``k`` observed segments."""

    def __init__(self, k: int):
        self.k = k

    def start(self) -> list[int]:
        return []

    def select(self, state: list[int], idx: int, prompt: str) -> list[int]:
        return state

    def observe(self, state: list[int], idx: int, prompt: str, result: str) -> list[int]:
        return [idx, *state][: self.k]


class MostShared:
    """The ``k`` observed segments that share most words with the prompt, the newer of equals; those that share none are left out.

    Remembers each observed segment's words, as many as a story has.
    """

    def __init__(self, k: int):
        self.k = k

    def start(self) -> dict[str, list[str]]:
        return {}

    def select(self, state: dict[str, list[str]], idx: int, prompt: str) -> list[int]:
        words = set(prompt.lower().split())
        shared = sorted((-len(words.intersection(held)), -int(i)) for i, held in state.items())
        return [-i for n, i in shared[: self.k] if n]

    def observe(self, state: dict[str, list[str]], idx: int, prompt: str, result: str) -> dict[str, list[str]]:
        return {**state, str(idx): sorted(set(prompt.lower().split()))}


def _usable(sources: list[int], idx: int) -> list[int]:
    """The sources once each; one that isn't in the past is an error of the policy."""
    late = [s for s in sources if s >= idx]
    if late:
        raise ValueError(f"segment {idx} was given the sources {late}, which are not before it")
    return list(dict.fromkeys(sources))


class Story:
    """One story's loop, a segment at a time."""

    def __init__(self, story: int, policy: Policy, realiser: Realiser, most_failures: int, state: str | None):
        self.story, self.policy, self.realiser, self.most = story, policy, realiser, most_failures
        self.memory, self.last, self.failures = json.loads(state) if state else (policy.start(), -1, 0)

    def stored(self) -> str:
        return json.dumps([self.memory, self.last, self.failures])

    def take(self, idx: int, prompt: str, closed: str | None) -> tuple | None:
        """The record of a segment; none if it was taken before or the story is given up."""
        if idx <= self.last or self.failures >= self.most:
            return None
        self.last = idx
        sources = _usable(self.policy.select(self.memory, idx, prompt), idx)
        told, error = closed, None
        if closed is None:
            try:
                told = self.realiser.realise(self.story, idx, prompt, sources)
            except Exception as e:  # an isolated failure skips the segment
                error = f"{type(e).__name__}: {e}"
        if error is None:
            self.failures = 0
            self.memory = self.policy.observe(self.memory, idx, prompt, told)
        else:
            self.failures += 1
        return self.story, idx, "failed" if error else "ok", ",".join(map(str, sources)), told, error, closed is not None


def closed_loop(segments: DataFrame, policy: Policy, realiser: Realiser, most_failures: int = 3) -> DataFrame:
    """Records (story, idx, status, sources, result, error, resumed) of a stream or table of segments.

    segments: story, idx, prompt and, if there, closed (the result of a segment that is
    not to be realised again). A micro-batch is taken in its stories' order; a segment that comes again is taken once.
    """
    closed = F.col("closed") if "closed" in segments.columns else F.lit(None)
    rows = segments.select(F.col("story").cast("long").alias("story"), F.col("idx").cast("long").alias("idx"), F.coalesce("prompt", F.lit("")).alias("prompt"), closed.cast("string").alias("closed"))

    def records(loop: Story, rows: pd.DataFrame) -> pd.DataFrame:
        told = (loop.take(i, p, None if pd.isna(c) else c) for i, p, c in rows[["idx", "prompt", "closed"]].itertuples(index=False, name=None))
        return pd.DataFrame([r for r in told if r], columns=[c.split()[0] for c in RECORD.split(", ")])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        loop = Story(key[0], policy, realiser, most_failures, state.get[0] if state.exists else None)
        out = records(loop, pd.concat(frames).sort_values("idx"))
        state.update((loop.stored(),))
        yield out

    if rows.isStreaming:
        return rows.groupBy("story").applyInPandasWithState(step, RECORD, "loop string", "append", GroupStateTimeout.NoTimeout)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loop = None
        for frame in frames:
            for story, part in frame.groupby("story", sort=False):
                if loop is None or loop.story != story:
                    loop = Story(int(story), policy, realiser, most_failures, None)
                yield records(loop, part)

    return rows.repartition("story").sortWithinPartitions("story", "idx").mapInPandas(walk, RECORD)


def closed_prefix(records: DataFrame) -> DataFrame:
    """The records (story, idx, status, result, ...) of each story up to its first failed or missing segment."""
    order = Window.partitionBy("story").orderBy("idx")
    broken = (F.row_number().over(order) - 1 != F.col("idx")) | (F.col("status") != "ok")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("_broken", broken).withColumn("_broken", F.max("_broken").over(sofar)).where(~F.col("_broken")).drop("_broken")


def taken_up(segments: DataFrame, records: DataFrame) -> DataFrame:
    """``segments`` with ``closed``: the results of another run's closed prefix (records may be a table beside a stream)."""
    done = closed_prefix(records).select("story", "idx", F.coalesce("result", F.lit("")).alias("closed"))
    return segments.join(done, ["story", "idx"], "left")


def manifest(segments: DataFrame, records: DataFrame) -> DataFrame:
    """story, total, ok, failed, resumed, given_up: one row a story."""
    total = segments.groupBy("story").agg(F.count(F.lit(1)).alias("total"))
    counts = records.groupBy("story").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("resumed").alias("resumed"), F.count(F.lit(1)).alias("n")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return total.join(counts, "story", "left").select("story", "total", n("ok"), n("failed"), n("resumed"), (F.coalesce("n", F.lit(0)) < F.col("total")).alias("given_up"))
