"""Votes, tallies, rates, leaderboards, calibration and paired resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio
from tidemark.sources.checkpoints import durable


def majority_vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """``vote`` and ``agreement`` of each key; a null vote abstains; of equally frequent votes the first cast wins."""
    cast = votes.withColumn("vote", F.coalesce("vote", F.lit("abstain")))
    per_vote = cast.groupBy(*keys, "vote").agg(F.count(F.lit(1)).alias("n"), F.min("call").alias("first_call"))
    # The greatest struct: most votes, then the earliest call.
    best = F.max(F.struct("n", (-F.col("first_call")).alias("early"), "vote"))
    return per_vote.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("calls")).select(
        *keys, F.col("b.vote").alias("vote"), ratio(F.col("b.n"), F.col("calls")).alias("agreement")
    )


def capability_tally(facts: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a judged cast: how many rows of each condition, and how many of them hit.

    ``facts``: gap (nullable), op, hit (boolean, nullable for an abstention), and the columns ``by``.
    """
    judged = F.col("hit").isNotNull()

    def pair(name: str, cond: Column) -> list[Column]:
        return [
            F.count_if(judged & cond).alias(f"{name}_n"),
            F.count_if(judged & cond & F.col("hit")).alias(f"{name}_hit"),
        ]

    long_gap = F.coalesce(F.col("gap") >= 30, F.lit(False))
    return facts.groupBy(*by).agg(
        *pair("all", F.lit(True)),
        *pair("introduce", F.col("op") == "introduce"),
        *pair("persist", F.col("op") == "persist"),
        *pair("continuity", (F.col("op") == "recall") & ~long_gap),
        *pair("long_gap", long_gap),
        F.count_if(~judged).alias("abstained"),
    )


def pooled_rates(tallies: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Micro average: counters are summed before they are divided."""
    return tallies.groupBy(*by).agg(
        *[ratio(F.sum(f"{n}_hit"), F.sum(f"{n}_n")).alias(f"{n}_rate") for n in names]
    )


def coverage_scores(refs: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every segment of ``expected``.

    ``refs``: segment, ref, entity (null where a reference shows none);
    ``expected``: segment, entities (array). Precision: share of references with
    an expected or any other entity; recall: share of the expected entities that
    references cover, 1 where none is expected. Without references precision and
    F1 are null and recall is 0 (1 where none is expected).
    """
    # One grouping: a segment's references are few, and each is kept once with and once without an entity at most.
    found = refs.groupBy("segment").agg(
        F.collect_set(F.struct("ref", F.col("entity").isNotNull().alias("useful"))).alias("refs"), F.collect_set("entity").alias("seen")
    )
    distinct = lambda rows: F.size(F.array_distinct(F.transform(rows, lambda r: r["ref"])))
    found = found.select("segment", "seen", distinct("refs").alias("n_refs"), distinct(F.filter("refs", lambda r: r["useful"])).alias("n_useful"))
    rows = expected.join(found, "segment", "left")
    n_refs = F.coalesce("n_refs", F.lit(0))
    wanted = F.array_distinct("entities")
    covered = F.size(F.array_intersect(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    precision = F.when(n_refs > 0, F.round(F.col("n_useful") / F.nullif(n_refs, F.lit(0)), 4))
    recall = F.when(F.size(wanted) == 0, 1.0).otherwise(F.round(covered / F.nullif(F.size(wanted), F.lit(0)), 4))
    rows = rows.select("segment", n_refs.cast("long").alias("n_refs"), precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn(
        "f1", F.when(p + r == 0, 0.0).otherwise(F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 4))
    )


def pair_redundancy(items: DataFrame, keys: list[str], similarity: Column) -> DataFrame:
    """Mean similarity over the unordered pairs of each group; columns of the pair's sides are l and r.

    ``items`` needs ``item`` (order within the group). Groups are small (the references of a segment).
    """
    left, right = items.alias("l"), items.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.item") < F.col("r.item")]
    return (
        left.join(right, on)
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(similarity).alias("mean_similarity"))
    )


def macro_board(rows: DataFrame, system: str, dataset: str, metric: str) -> DataFrame:
    """Macro averages of each system, over all its datasets and for each: grouping sets."""
    return (
        rows.cube(system, dataset)
        .agg(
            F.grouping_id().alias("level"),
            F.count(F.lit(1)).alias("n_samples"),
            F.count(metric).alias("n_scored"),
            F.round(F.avg(metric), 6).alias("mean_score"),
        )
        .where(F.col("level").isin(0, 1))
        .drop("level")
    )


def roll_up_cells(units: DataFrame) -> DataFrame:
    """Each unit in its cells: by stratum; by stratum, kind and gap; by stratum and kind; and main units by gap."""
    cell = F.array(
        F.concat_ws("|", "stratum", F.lit("all")),
        F.concat_ws("|", "stratum", "kind", "gap_bin"),
        F.concat_ws("|", "stratum", "kind"),
        F.when(F.col("stratum") == "main", F.concat_ws("|", F.lit("main|all"), "gap_bin")),
    )
    return units.withColumn("cell", F.explode(F.array_compact(cell)))


def auc(scored: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count a half; null without both classes.

    Equal scores are counted together first, so the window runs over distinct scores.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")
    )
    order = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("n").over(order) - F.col("n")
    return (
        counts.withColumn("wins", F.col("p") * (below + F.col("n") / 2.0))
        .groupBy(*by)
        .agg(
            F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"),
            F.round(F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 4).alias("auc"),
        )
    )


def youden(scored: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Threshold t of the rule score >= t with the largest J; of equals the lowest. J is rounded after the choice."""
    counts = scored.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")
    )
    own = Window.partitionBy(*by)
    up = own.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.select(
        *by, score, F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(own).alias("all_p"), F.sum("n").over(own).alias("all_n")
    )
    # Compared as whole numbers, J times both totals, so that no rounding decides.
    rows = rows.withColumn("x", F.struct((F.col("tp") * F.col("all_n") - F.col("fp") * F.col("all_p")).alias("w"), (-F.col(score)).alias("t"), "tp", "fp", "all_p", "all_n"))
    best = rows.groupBy(*by).agg(F.max("x").alias("x"))
    j = F.col("x.tp") / F.nullif(F.col("x.all_p"), F.lit(0)) - F.col("x.fp") / F.nullif(F.col("x.all_n"), F.lit(0))
    return best.select(*by, (-F.col("x.t")).alias("threshold"), F.round(j, 4).alias("j"))


def inverse_weighted_shares(rows: DataFrame, group: str, probability: str) -> DataFrame:
    """Share of each group when rows are weighted by the inverse of their inclusion probability."""
    weights = rows.groupBy(group).agg(F.sum(1.0 / F.col(probability)).alias("w"), F.count(F.lit(1)).alias("n"))
    whole = F.sum("w").over(Window.partitionBy())  # one row a group
    return weights.select(group, "n", F.round(F.col("w") / whole, 6).alias("share"))


def bootstrap(tallies: DataFrame, draws: DataFrame, by: str) -> DataFrame:
    """Percentile interval of a pooled rate over story-clustered draws.

    ``tallies``: story, ``by``, hit, n; ``draws``: draw, story (repeats allowed).
    The bounds are the elements at int(.025 m) and int(.975 m) - 1 of the sorted draws.
    """
    drawn = draws.groupBy("draw", "story").agg(F.count(F.lit(1)).alias("times"))
    rates = (
        drawn.join(tallies, "story")
        .groupBy("draw", by)
        .agg((F.sum(F.col("times") * F.col("hit")) / F.nullif(F.sum(F.col("times") * F.col("n")), F.lit(0))).alias("rate"))
        .where(F.col("rate").isNotNull())
    )
    ordered = F.array_sort(F.collect_list("rate"))  # one number a draw
    at = lambda share, less: F.get(F.col("o"), F.greatest(F.lit(0), F.floor(share * F.size("o")).cast("int") - less))
    return rates.groupBy(by).agg(ordered.alias("o")).select(
        by, F.size("o").alias("n_draws"), F.round(at(0.025, 0), 6).alias("low"), F.round(at(0.975, 1), 6).alias("high")
    )


def rank_quantiles(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n and, for each name in ``ranks``, the value at that place (from 0, an expression over n) of the sorted values.

    Equal values are counted first and places are found in running counts, so no key's values are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*keys)
    upto = F.sum("_c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "n": F.sum("_c").over(own)})
    return ranked.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in ranks.items()])


def capacity_plan(stories: DataFrame, order: list[str], segments: str, seconds_per_segment: float, load_seconds: float) -> DataFrame:
    """Running totals of segments and hours in the given order, and the longest story so far.

    Stories are sorted by ranges; totals run inside each range, and over the ranges' own totals.
    """
    cost = (F.col(segments) * seconds_per_segment + load_seconds) / 3600.0
    rows = durable(
        stories.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), "_cost": cost})
    )
    totals = {"_s": F.sum(segments), "_h": F.sum("_cost"), "_m": F.max(segments)}
    parts = rows.groupBy("_part").agg(*[c.alias(n) for n, c in totals.items()])  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.sum("_s").over(before).alias("_s"), F.sum("_h").over(before).alias("_h"), F.max("_m").over(before).alias("_m"))
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(parts), "_part")
    return out.withColumns(
        {
            "cum_segments": F.sum(segments).over(run) + F.coalesce("_s", F.lit(0)),
            "cum_hours": F.round(F.sum("_cost").over(run) + F.coalesce("_h", F.lit(0.0)), 6),
            "longest": F.greatest(F.max(segments).over(run), "_m"),
        }
    ).select(*stories.columns, "cum_segments", "cum_hours", "longest")
