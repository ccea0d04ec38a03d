"""Gates, reasons and choices of the curation steps; each keeps its rows and adds a verdict, or reports what breaks a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lint import area, overlap
from tidemark.operators.scoring import auc

# Head nouns of places and of things that can be carried, words that say nothing, reasons that hide a crop.
PLACE_WORDS = ("background", "beach", "canopy", "cave", "clearing", "creek", "field", "forest", "grassland", "ground", "hill", "lake", "meadow", "path", "river", "road", "sky", "valley")
THING_WORDS = ("apple", "arrow", "boulder", "bow", "fruit", "glider", "leaf", "nut", "rock", "stick")
EMPTY_WORDS = ("a", "of", "the", "with")
HIDING_REASONS = ("cross_entity_bbox_conflict", "identity_mismatch", "missing_crop", "no_library_crop_for_slot", "not_accepted", "picker_rejected", "picker_request_failed")
PLAIN_REASONS = ("current_appearance_le_t", "coverage_acquire")


def causal_violations(refs: DataFrame) -> DataFrame:
    """References whose source is not a strictly earlier segment of the same run; the first broken rule is told.

    refs: run (its folder), current, representation_id ("c00012@..."), image_ref.
    """
    source = F.regexp_extract("representation_id", r"^c(\d{5})@", 1)
    reason = (
        F.when(F.coalesce(source, F.lit("")) == "", "no_source")
        .when(source.cast("int") >= F.col("current"), "not_earlier")
        .when(~F.coalesce(F.col("image_ref").startswith(F.concat("run", F.lit("/"))), F.lit(False)), "outside_run")
    )
    return refs.withColumn("reason", reason).where(F.col("reason").isNotNull())


def kind_mixtures(entities: DataFrame) -> DataFrame:
    """movie, entity_id, flags of the entities whose name speaks against their kind.

    entities: movie, entity_id, kind, name. Words of the movie's characters are
    met by word, so a movie's entities are never paired.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("name"), "[_ ]+", " "), " "), lambda w: w != "")
    rows = entities.withColumn("words", words).withColumn("head", F.coalesce(F.get("words", F.size("words") - 1), F.lit("")))
    spoken = rows.where("kind = 'character'").select("movie", F.explode("words").alias("word")).distinct()
    spoken = spoken.where(~F.col("word").isin(*EMPTY_WORDS))
    others = rows.where("kind != 'character'")
    met = others.select("movie", "entity_id", F.explode(F.array_distinct("words")).alias("word")).join(spoken, ["movie", "word"])
    hits = met.groupBy("movie", "entity_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("word"))).alias("hits"))
    flags = F.array(
        F.when((F.col("kind") == "prop") & F.col("head").isin(*PLACE_WORDS), F.format_string("prop named like a place (%s)", "head")),
        F.when((F.col("kind") == "location") & F.col("head").isin(*THING_WORDS), F.format_string("location named like a thing (%s)", "head")),
        F.when(F.col("hits").isNotNull(), F.concat(F.lit("names a character's word: "), F.col("hits"))),
    )
    out = others.join(hits, ["movie", "entity_id"], "left").select("movie", "entity_id", F.concat_ws("; ", F.array_compact(flags)).alias("flags"))
    return out.where("flags != ''")


def closeups(shots: DataFrame, threshold: float) -> DataFrame:
    """``closeup``: any box [x0, y0, x1, y1] of the shot covers more than ``threshold`` of the frame."""
    part = lambda b: (F.get(b, F.lit(2)) - F.get(b, F.lit(0))) * (F.get(b, F.lit(3)) - F.get(b, F.lit(1))) / F.lit(1e6)
    return shots.withColumn("closeup", F.exists("boxes", lambda b: (F.size(b) >= 4) & (part(b) > threshold)))


def crop_reasons(proposals: DataFrame) -> DataFrame:
    """``reasons`` in the order they come up, and ``hidden`` from people.

    proposals: qa_reasons, accepted (may be null), reason, task_kind, crop_path.
    """
    said = F.filter(F.transform(F.coalesce("qa_reasons", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    own = F.trim(F.coalesce("reason", F.lit("")))
    more = F.when(F.coalesce(~F.col("accepted"), F.lit(False)), F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise("not_accepted")).when(
        (own != "") & ~own.isin(*PLAIN_REASONS), own
    )
    reasons = F.array_distinct(F.array_compact(F.concat(said, F.array(more))))
    hidden = (
        (F.coalesce("task_kind", F.lit("acquire")) == "slot_bind") | F.coalesce(~F.col("accepted"), F.lit(False))
        | (F.trim(F.coalesce("crop_path", F.lit(""))) == "") | F.arrays_overlap("reasons", F.array(*map(F.lit, HIDING_REASONS)))
    )
    return proposals.withColumn("reasons", reasons).withColumn("hidden", hidden)


def final_verdicts(reviews: DataFrame, overrides: DataFrame) -> DataFrame:
    """``final`` and ``blocks``: a resolved override, else the verdict, else what acceptance says.

    reviews: segment_id, verdict, accepted; overrides: segment_id, resolved (one a segment).
    """
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = reviews.join(overrides, "segment_id", "left")
    final = F.coalesce(given("resolved"), given("verdict"), F.when(F.coalesce("accepted", F.lit(False)), "PASS").otherwise("BLOCK"))
    return rows.withColumn("final", final).withColumn("blocks", F.col("final") == "BLOCK")


def resume_action(movies: DataFrame) -> DataFrame:
    """``action`` of each movie from what its folders hold.

    movies: published, s4_reviewed, s6_reviewed, s4_queue, s6_queue, proposals (booleans).
    """
    ready = F.col("proposals") | F.col("s6_queue")
    action = (
        F.when(F.col("published"), "complete").when(F.col("s6_reviewed"), "after_s6").when(ready, "awaiting_human")
        .when(F.col("s4_reviewed"), "after_s4").when(F.col("s4_queue"), "awaiting_human").otherwise("pipeline")
    )
    return movies.withColumn("action", action)


def dispatch_urls(instances: DataFrame, keys: list[str], role: str | None = None) -> DataFrame:
    """Urls that work may go to: online, not on a break, once each; those of the role if there are any, else the others.

    instances: keys, seq, url, role, online, on_break.
    """
    usable = instances.where(F.col("online") & ~F.col("on_break")).withColumn("url", F.regexp_replace("url", "/+$", "")).where("url != ''")
    first = Window.partitionBy(*keys, "url").orderBy("seq")
    rows = usable.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    fits = F.lit(True) if role is None else F.coalesce("role", F.lit("reviewer")).isin(role, "any")
    rows = rows.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(Window.partitionBy(*keys)))
    return rows.where(F.col("_fits") == F.col("_any")).select(*keys, "seq", "url")


def perception_gate(located: DataFrame, max_area: float, max_iou: float) -> DataFrame:
    """``blocked``: crops too large, and then both of each pair that share a box and of which neither was blocked before.

    located: chunk, seq, kind, bbox_source, bbox. Pairs are taken in order of seq, each
    depending on those before, so a chunk's crops (a handful) are folded in one row.
    """
    gated = (F.col("kind") != "location") & (F.col("bbox_source") == "grounding_dino")
    rows = located.withColumn("big", gated & (area(F.col("bbox")) > max_area))
    crops = rows.where(gated & ~F.col("big")).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "bbox"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: (b["seq"] > a["seq"]) & (overlap(a["bbox"], b["bbox"]) >= max_iou)), lambda b: F.struct(a["seq"].alias("a"), b["seq"].alias("b")))))
    hit = F.aggregate(
        pairs, F.array().cast("array<bigint>"),
        lambda done, p: F.when(F.array_contains(done, p["a"]) | F.array_contains(done, p["b"]), done).otherwise(F.concat(done, F.array(p["a"].cast("bigint"), p["b"].cast("bigint")))),
    )
    shared = crops.select("chunk", F.explode(hit).alias("seq")).withColumn("_shared", F.lit(True))
    return rows.join(shared, ["chunk", "seq"], "left").withColumn("blocked", F.col("big") | F.coalesce("_shared", F.lit(False))).drop("big", "_shared")


def seen_before_plan(cast: DataFrame, kinds: tuple[str, ...] = ("character", "prop")) -> DataFrame:
    """story, idx, sources of each segment: where its entities were last seen, the longest gap first, then by id."""
    rows = cast.where(F.col("last_seen").isNotNull() & (F.col("op") != "introduce") & F.col("kind").isin(*kinds))
    plan = rows.groupBy("story", "idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("g"), "eid", "last_seen"))).alias("p"))
    return plan.select("story", "idx", F.transform("p", lambda p: p["last_seen"]).alias("sources"))


def similarity_rates(units: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Detection and consistency rates of units (det_a, det_b, sim, null unless both are detected)."""
    both = F.count("sim")
    n = F.count(F.lit(1))
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    cons = F.count_if(F.col("sim") >= threshold)
    return units.groupBy(*by).agg(
        n.alias("n"), rate(cons, n).alias("consistent_rate"), rate(cons, both).alias("consistent_given_both"),
        rate(F.sum("sim"), both).alias("mean_similarity"), rate(F.count_if("det_a"), n).alias("detected_a_rate"),
        rate(F.count_if("det_b"), n).alias("detected_b_rate"), rate(both, n).alias("both_detected_rate"),
    )


def calibration(controls: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Per modality: control counts, AUC, the Youden threshold and the share of negatives below it.

    Scores are counted by value first, so no window runs over rows.
    """
    counts = controls.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")
    )
    own = Window.partitionBy(*by)
    up = own.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    tpr = F.sum("p").over(up) / F.nullif(F.sum("p").over(own), F.lit(0))
    fpr = F.sum("n").over(up) / F.nullif(F.sum("n").over(own), F.lit(0))
    # J is compared as a fraction of whole numbers, so that no rounding decides.
    p, n = F.sum("p").over(own), F.sum("n").over(own)
    whole = F.sum("p").over(up) * n - F.sum("n").over(up) * p
    rows = counts.withColumns({"tpr": tpr, "fpr": fpr, "whole": whole})
    best = rows.groupBy(*by).agg(F.max(F.struct("whole", (-F.col(score)).alias("t"), "tpr", "fpr")).alias("b"))
    youden = best.where(F.col("b.tpr").isNotNull() & F.col("b.fpr").isNotNull()).select(
        *by, F.round(-F.col("b.t"), 6).alias("threshold"), F.round("b.tpr", 4).alias("tpr"), F.round("b.fpr", 4).alias("fpr"),
        F.round(F.col("b.tpr") - F.col("b.fpr"), 4).alias("youden_j"), F.round(1 - F.col("b.fpr"), 4).alias("neg_below_threshold"),
    )
    return auc(controls, by, score, positive).join(youden, by, "left")


def representative_crops(reps: DataFrame) -> DataFrame:
    """movie, entity_id, crop_path of the best grounded crop: by score, then the earliest frame, then the largest id."""
    best = F.max(F.struct(F.coalesce("grounding_score", F.lit(0.0)).alias("s"), (-F.col("frame_index")).alias("f"), "representation_id", "crop_path"))
    return reps.where(F.coalesce(F.col("crop_path") != "", F.lit(False))).groupBy("movie", "entity_id").agg(best.alias("b")).select("movie", "entity_id", "b.representation_id", "b.crop_path")


def reassigned(ranked: DataFrame, item: str, margin: float) -> DataFrame:
    """item, label: the most probable label if it beats the current one by ``margin``, else the current one.

    ranked: item, current, label, prob; a current label that was not ranked counts as 0.
    """
    top = F.max(F.struct("prob", F.col("seq").alias("s"), "label"))
    rows = ranked.withColumn("seq", -F.col("seq")).groupBy(item, "current").agg(
        top.alias("t"), F.coalesce(F.max(F.when(F.col("label") == F.col("current"), F.col("prob"))), F.lit(0.0)).alias("own")
    )
    wins = (F.col("t.label") != F.col("current")) & (F.col("t.prob") - F.col("own") >= margin)
    return rows.select(item, F.when(wins, F.col("t.label")).otherwise(F.col("current")).alias("label"))


def exclusive_assignment(scores: DataFrame, keys: list[str], floor: float, margin: float) -> DataFrame:
    """keys, entity, candidate, sim: each candidate asks for its best entity, and each entity takes the best that asks.

    scores: keys, candidate, entity, sim (one exemplar a row). A candidate asks only from
    ``floor`` on and if its best entity leads the next one by ``margin``.
    """
    best = scores.groupBy(*keys, "candidate", "entity").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy(*keys, "candidate").orderBy(F.desc("sim"), "entity")
    asks = best.withColumns({"_r": F.row_number().over(order), "_next": F.lead("sim").over(order)}).where(
        (F.col("_r") == 1) & (F.col("sim") >= floor) & (F.coalesce(F.col("sim") - F.col("_next"), F.lit(9.0)) >= margin)
    )
    won = asks.groupBy(*keys, "entity").agg(F.max(F.struct("sim", "candidate")).alias("w"))
    return won.select(*keys, "entity", "w.candidate", "w.sim")


def matched_phrases(labels: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, phrase: the phrase that shares most words with the label, of equals the first; labels without a shared word go.

    Words are met by equality, so labels and phrases are never paired as such.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    l = labels.select(*keys, "label").distinct().select(*keys, "label", F.explode(words(F.col("label"))).alias("word"))  # noqa: E741
    p = phrases.select(*keys, "seq", "phrase", F.explode(words(F.col("phrase"))).alias("word"))
    n = l.join(p, [*keys, "word"]).groupBy(*keys, "label", "seq", "phrase").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys, "label").agg(F.max(F.struct("n", (-F.col("seq")).alias("s"), "phrase")).alias("b"))
    return best.select(*keys, "label", "b.phrase", F.col("b.n").alias("n_shared"))


def set_differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n_missing, n_extra: how two tables differ as sets of ``columns``, for the keys where they do."""
    side = lambda df, c: df.select(*keys, *columns).distinct().withColumn(c, F.lit(1))
    both = side(a, "_a").join(side(b, "_b"), [*keys, *columns], "full_outer")
    out = both.groupBy(*keys).agg(F.count_if(F.col("_b").isNull()).alias("n_missing"), F.count_if(F.col("_a").isNull()).alias("n_extra"))
    return out.where("n_missing > 0 or n_extra > 0")


def united_feedback(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feedback: the details of failed checks, once each, in the order they came first."""
    failed = checks.where(~F.col("passed") & (F.coalesce("detail", F.lit("")) != ""))
    first = failed.groupBy(*keys, "detail").agg(F.min("seq").alias("seq"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "detail"))), lambda x: x["detail"]).alias("feedback"))


def keyed_decoys(candidates: DataFrame, keys: list[str], item: str, n: int, seed: str) -> DataFrame:
    """``n`` items of each key in the order of a keyed hash; the same in every run."""
    draw = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(item).cast("string")), 256)
    order = Window.partitionBy(*keys).orderBy(draw, item)
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def legacy_path(path: Column) -> Column:
    """Which layout a crop path follows: bank, flat, derived, candidate or other."""
    kinds = "|".join(("characters", "props", "locations"))
    return (
        F.when(path.rlike(rf"^assets/(?:{kinds})/[^/]+/"), "bank").when(path.rlike("^assets/[^/]+/"), "flat")
        .when(path.rlike("^derived/assets/[^/]+/"), "derived").when(path.rlike("(?:^|/)tmp/"), "candidate").otherwise("other")
    )


def sibling_decisions(decisions: DataFrame, crops: DataFrame) -> DataFrame:
    """Crops with the decision of the one whose entity and file name they share; the latest decision counts."""
    leaf = lambda c: F.substring_index(F.regexp_replace(c, r"\\", "/"), "/", -1)
    made = decisions.select("entity_id", leaf("crop_path").alias("leaf"), "seq", "decision")
    last = made.groupBy("entity_id", "leaf").agg(F.max(F.struct("seq", "decision")).alias("d")).select("entity_id", "leaf", "d.decision")
    return crops.withColumn("leaf", leaf("crop_path")).join(last, ["entity_id", "leaf"], "left")


def readiness(movies: DataFrame, stages: list[str]) -> DataFrame:
    """``missing``: the stages a movie still lacks, in order; ``ready`` without any."""
    gaps = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in stages]))
    return movies.withColumn("missing", F.concat_ws(",", gaps)).withColumn("ready", F.col("missing") == "")


def strict_answer(text: Column, allowed: Column) -> Column:
    """The ids of a JSON answer {"entity_ids": [...]}; null unless it is one and names nothing but ``allowed``."""
    ids = F.from_json(text, "entity_ids array<string>")["entity_ids"]
    clean = F.size(F.array_except(ids, allowed)) == 0
    return F.when(ids.isNotNull() & clean & ~F.array_contains(F.transform(ids, lambda x: F.coalesce(x, F.lit("\0"))), "\0"), F.array_sort(F.array_distinct(ids)))
