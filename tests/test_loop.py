"""The closed loop: order, failures, giving up, resuming, and a stream that is killed and started again."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.streaming import loop

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests on their path

SEGMENTS = "story long, idx long, prompt string"


class Film:
    """Fails at the given (story, idx); dies once at ``fatal`` while the file ``armed`` is there."""

    def __init__(self, bad=(), fatal=None, armed=None):
        self.bad, self.fatal, self.armed = set(bad), fatal, armed

    def realise(self, story, idx, prompt, sources):
        if self.fatal == (story, idx) and self.armed and os.path.exists(self.armed):
            raise KeyboardInterrupt("the machine is gone")
        if (story, idx) in self.bad:
            raise OSError("no space")
        return f"{prompt}<{'+'.join(map(str, sources))}"


class Seer(loop.Newest):
    def select(self, state, idx, prompt):
        return [idx]


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_records_of_a_run(spark):
    rows = spark.createDataFrame([(1, i, f"p{i}") for i in range(4)] + [(1, 2, "again")] + [(2, i, "q") for i in range(6)] + [(3, 0, None)], SEGMENTS).repartition(3)
    got = told(loop.closed_loop(rows, loop.Newest(2), Film([(1, 1), (2, 1), (2, 2)]), most_failures=2).where("story <> 1 or idx <> 2"))
    assert got == [
        (1, 0, "ok", "", "p0<", None, False), (1, 1, "failed", "0", None, "OSError: no space", False), (1, 3, "ok", "2,0", "p3<2+0", None, False),
        (2, 0, "ok", "", "q<", None, False), (2, 1, "failed", "0", None, "OSError: no space", False), (2, 2, "failed", "0", None, "OSError: no space", False), (3, 0, "ok", "", "<", None, False),
    ]
    with pytest.raises(Exception, match="not before it"):
        loop.closed_loop(rows, Seer(1), Film()).collect()


def test_most_shared_words(spark):
    prompts = ["the red kite", "a blue boat", "red boat on the lake", "nothing else", "the kite over the lake"]
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(prompts)], SEGMENTS)
    got = {r.idx: r.sources for r in loop.closed_loop(rows, loop.MostShared(2), Film()).collect()}
    assert got == {0: "", 1: "", 2: "0,1", 3: "", 4: "2,0"}


def test_taken_up_from_the_closed_prefix(spark):
    rows = spark.createDataFrame([(s, i, f"p{i}") for s in (1, 2, 3) for i in range(5)], SEGMENTS)
    first = loop.closed_loop(rows, loop.Newest(3), Film([(1, 3), (2, 0)]))
    assert sorted((r.story, r.idx) for r in loop.closed_prefix(first).collect()) == [(1, 0), (1, 1), (1, 2), *((3, i) for i in range(5))]
    assert loop.closed_prefix(first.where("idx <> 1")).count() == 2
    second = loop.closed_loop(loop.taken_up(rows, first), loop.Newest(3), Film([(1, 1), (3, 0)]))  # they are closed and not made again
    whole = loop.closed_loop(rows, loop.Newest(3), Film())
    assert told(second.drop("resumed")) == told(whole.drop("resumed"))
    assert {tuple(r) for r in loop.manifest(rows, second).collect()} == {(1, 5, 5, 0, 3, False), (2, 5, 5, 0, 0, False), (3, 5, 5, 0, 5, False)}
    lost = loop.closed_loop(rows, loop.Newest(3), Film([(2, 1), (2, 2)]), most_failures=2)
    assert loop.manifest(rows, lost).where("given_up").select("story", "ok", "failed").collect() == [(2, 1, 2)]


def test_killed_and_restarted(spark, tmp_path):
    """A stream that dies in its third batch and is started again leaves the records of an unbroken one."""
    rows = spark.createDataFrame([(s, i, f"p{i}") for s in range(5) for i in range(12)], SEGMENTS)
    for k in range(6):  # two segments of every story a file
        rows.where(F.col("idx").between(2 * k, 2 * k + 1)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        for path in (tmp_path / "in" / f"p{k}").glob("*.parquet"):
            os.utime(path, (1_700_000_000 + k,) * 2)
    bad = [(1, 4), (2, 3), (2, 4), (2, 5), (3, 11)]
    armed = tmp_path / "armed"
    armed.write_text("x")

    def run(film):
        stream = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = (
            loop.closed_loop(stream, loop.Newest(2), film).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()

    film = Film(bad, (4, 5), str(armed))
    with pytest.raises(Exception):
        run(film)
    half = spark.read.schema(loop.RECORD).parquet(str(tmp_path / "out")).count()
    assert 0 < half < 55
    armed.unlink()
    run(film)
    want = told(loop.closed_loop(rows, loop.Newest(2), Film(bad)))
    assert told(spark.read.schema(loop.RECORD).parquet(str(tmp_path / "out"))) == want
    assert len(want) == 60 - 6
