"""Filters, verdicts, rule sets, sampling and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings(rules: list[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """(code, severity, path) of every row that a rule's frame holds; rules are unioned, nothing is collected."""
    out = None
    for code, severity, rows, path in rules:
        part = rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.cast("string").alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_contiguous(rows: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Rows whose index isn't one more than the row before (the first must be 0)."""
    order = Window.partitionBy(*keys).orderBy(idx)
    return rows.withColumn("_want", F.coalesce(F.lag(idx).over(order) + 1, F.lit(0))).where(F.col(idx) != F.col("_want")).drop("_want")


def materialised(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items with their source time (given, or the middle of their chunk) and what becomes of them.

    items: story, item, at_chunk, seconds (nullable), source_chunk; chunks: story,
    chunk_id, lo, hi. An item whose time isn't before its own chunk's start is dropped as future.
    """
    own = chunks.select("story", F.col("chunk_id").alias("at_chunk"), F.col("lo").alias("own_lo"))
    src = chunks.select("story", F.col("chunk_id").alias("source_chunk"), ((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    rows = items.join(own, ["story", "at_chunk"], "left").join(src, ["story", "source_chunk"], "left")
    at = F.coalesce("seconds", "mid")
    fate = (
        F.when(F.col("own_lo").isNull(), "no_chunk").when(at.isNull(), "unresolved").when(at >= F.col("own_lo"), "future")
        .when(F.col("seconds").isNull(), "from_chunk").otherwise("from_seconds")
    )
    return rows.withColumn("source_at", at).withColumn("fate", fate)


def review_verdict(accepted: Column, confidence: Column, retryable: Column, deterministic: Column, trusted: Column) -> Column:
    """Runtime failures are retried; deterministic or confident conflicts block; doubts warn unless labels are trusted."""
    doubt = confidence.isin("low", "medium")
    return (
        F.when(retryable, "RETRYABLE_ERROR").when(deterministic, "BLOCK").when((confidence == "high") & ~accepted, "BLOCK")
        .when(trusted & doubt & ~accepted, "PASS").when(~accepted | doubt, "WARN").otherwise("PASS")
    )


def event_fate(reversible: Column, explicit: Column, inferred: Column, known: list[str], allowed: Column) -> Column:
    """Why an event is rejected, in order of precedence; null if it is kept."""
    given = F.when(explicit.isin(*known), explicit)
    kind = F.coalesce(given, inferred)
    return (
        F.when(reversible, "reversible").when(kind.isNull(), "unknown")
        .when((explicit != "") & inferred.isNotNull() & (explicit != inferred), "mismatch")
        .when(allowed.isNotNull() & ~F.array_contains(allowed, kind), "not_allowed")
    )


def runs_at_ends(rows: DataFrame, keys: list[str], idx: str, flag: str) -> DataFrame:
    """Flagged rows of the runs that touch a group's first or last row."""
    own = Window.partitionBy(*keys)
    order = own.orderBy(idx)
    clear = F.when(~F.col(flag), F.col(idx))
    rows = rows.withColumn("_lo", F.min(clear).over(own)).withColumn("_hi", F.max(clear).over(own))
    head = F.col("_lo").isNull() | (F.col(idx) < F.col("_lo")) | (F.col(idx) > F.col("_hi"))
    return rows.where(F.col(flag) & head).withColumn("place", F.row_number().over(order)).drop("_lo", "_hi")


def stratified_sample(rows: DataFrame, item: str, rate: float, minimum: int, seed: str) -> DataFrame:
    """Every BLOCK and max(minimum, rate) of the WARN and PASS rows in proportion, both present where both exist.

    The order within a stratum is a keyed hash, so runs and engines agree. The
    quotas are two numbers, computed from counts.
    """
    eligible = rows.where("verdict != 'RETRYABLE_ERROR'")
    n = eligible.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "WARN").alias("w"), F.count_if(F.col("verdict") == "PASS").alias("p")
    )
    wanted = F.least(F.col("w") + F.col("p"), F.greatest(F.lit(minimum), F.bround(F.col("n") * rate).cast("long")))
    share = F.greatest(F.lit(1), F.bround(wanted * F.col("p") / F.nullif(F.col("w") + F.col("p"), F.lit(0))).cast("long"))
    p = F.when(F.col("w") == 0, wanted).when(F.col("p") == 0, 0).when(wanted == 1, (F.col("w") < F.col("p")).cast("long")).otherwise(
        F.least("p", share, F.greatest(wanted - 1, F.lit(0)))
    )
    quota = n.select(F.least("w", wanted - p).alias("q_warn"), F.least("p", wanted - F.least(F.col("w"), wanted - p)).alias("q_pass"))
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")), 256)
    # Strata are global, so ranks are taken in two steps: within hash ranges, then from their running counts.
    part = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    ranked = eligible.withColumns({"_k": key, "_p": part})
    sizes = ranked.groupBy("verdict", "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("verdict").orderBy("_p")) - F.col("_c")
    sizes = sizes.select("verdict", "_p", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("verdict", "_p").orderBy("_k", item)) + F.col("_before")
    out = ranked.join(sizes, ["verdict", "_p"]).withColumn("_place", place).join(F.broadcast(quota))
    keep = (F.col("verdict") == "BLOCK") | ((F.col("verdict") == "WARN") & (F.col("_place") <= F.col("q_warn"))) | (
        (F.col("verdict") == "PASS") & (F.col("_place") <= F.col("q_pass"))
    )
    return out.where(keep).select(*rows.columns)


def work_list(jobs: DataFrame, done: DataFrame, keys: list[str], shard: int, shards: int) -> DataFrame:
    """Jobs of a shard that have no result yet: an anti join and a keyed hash."""
    digest = F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256)
    mine = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards == shard
    return jobs.where(mine).join(done, keys, "left_anti")
