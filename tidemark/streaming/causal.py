"""The causal loop as a stream: each turn is answered from its story's earlier turns, then remembered.

State is what a story's next answer needs: its newest ``k`` segments, and no
more. Rows of a micro-batch are taken in story order; the answer of a row never
sees the row itself or a later one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.checkpoints import shared_folder

ANSWER = "story long, idx long, sources string, n_seen long"
MEMORY = "recent array<long>, seen long"


def answers(turns: DataFrame, k: int) -> DataFrame:
    """story, idx, sources (newest first, joined by commas), n_seen of every streamed turn (story, idx)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = []
        for idx in sorted(i for f in frames for i in f["idx"].tolist()):
            rows.append((key[0], idx, ",".join(map(str, recent)), seen))
            recent = [idx, *recent][:k]
            seen += 1
        state.update((recent, seen))
        yield pd.DataFrame(rows, columns=["story", "idx", "sources", "n_seen"])

    return turns.groupBy("story").applyInPandasWithState(step, ANSWER, MEMORY, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, delay: str, width: str) -> DataFrame:
    """Counts and sums of each event type in tumbling windows; rows later than ``delay`` are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def stream_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, to Parquet in the shared folder, and read the result.

    The sink commits each micro-batch once, so a restarted run adds nothing twice.
    """
    spark = stream.sparkSession
    folder = stream_folder(spark)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern serves for one file as well as for a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
