"""The study's sample: quotas, fallbacks, probabilities and order."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import study

QUOTAS = [("mid", 3), ("long", 4), ("far", 2), ("none", 5)]
BACK = {"long": "mid", "far": "mid"}


def pool(spark, sizes):
    rows = [(system, stratum, f"{system}-{stratum}-{k}") for system, stratum, n in sizes for k in range(n)]
    return spark.createDataFrame(rows, "system string, stratum string, unit string")


def test_quotas_fall_back_in_order(spark):
    units = pool(spark, [("a", "mid", 8), ("a", "long", 1), ("b", "mid", 4), ("b", "long", 9), ("b", "far", 1), ("c", "far", 1), (None, "mid", 2), ("a", None, 3), ("a", "other", 2)])
    picked = study.quota_sample(units, ["unit"], QUOTAS, BACK, "x")
    got = {(r.system, r.stratum, r.for_stratum): r["count"] for r in picked.groupBy("system", "stratum", "for_stratum").count().collect()}
    assert got == {
        ("a", "mid", "mid"): 3, ("a", "mid", "long"): 3, ("a", "mid", "far"): 2, ("a", "long", "long"): 1,
        ("b", "mid", "mid"): 3, ("b", "long", "long"): 4, ("b", "far", "far"): 1, ("b", "mid", "far"): 1,
        ("c", "far", "far"): 1, (None, "mid", "mid"): 2,
    }
    prob = {(r.system, r.stratum, r.for_stratum): (r.inclusion_prob, r.exact_prob) for r in picked.collect()}
    assert prob["b", "long", "long"] == (0.444444, 4 / 9) and prob["a", "mid", "far"] == (0.25, 1.0) and prob["b", "mid", "far"] == (0.5, 1.0)
    again = study.quota_sample(units.repartition(5).orderBy(F.desc("unit")), ["unit"], QUOTAS, BACK, "x")
    assert sorted(map(str, again.collect())) == sorted(map(str, picked.collect()))


def test_exact_probabilities_are_frequencies(spark):
    units = pool(spark, [("a", "mid", 10), ("a", "long", 2)])
    hits: dict[str, int] = {}
    for seed in range(12):
        picked = study.quota_sample(units, ["unit"], QUOTAS, BACK, str(seed)).collect()
        assert len(picked) == 9  # three and two for long and two for far from mid, two of long
        assert sum(r.exact_prob for r in picked if r.stratum == "mid") == pytest.approx(7 * 0.7)
        for r in picked:
            hits[r.unit] = hits.get(r.unit, 0) + 1
    mid = [n for u, n in hits.items() if "mid" in u]
    assert sum(mid) == 12 * 7 and len(mid) == 10 and min(mid) < 12


def test_fallback_must_come_first(spark):
    with pytest.raises(ValueError, match="must come before"):
        study.quota_sample(pool(spark, [("a", "mid", 1)]), ["unit"], [("long", 1), ("mid", 1)], BACK, "x")


def test_order_repeats_and_practice(spark):
    units = pool(spark, [("a", "mid", 60), ("b", "mid", 60)])
    picked = study.quota_sample(units, ["unit"], [("mid", 25)], {}, "x")
    shown = study.presentation(picked, ["unit"], 0.1, "x").orderBy("position").collect()
    assert [r.position for r in shown] == list(range(55)) and len({r.display_id for r in shown}) == 55
    first = {r.unit: r.position for r in shown if not r.is_repeat}
    again = [r for r in shown if r.is_repeat]
    assert len(first) == 50 and len(again) == 5
    assert all(r.base_unit < 25 and first[r.unit] < 25 < r.position for r in again)
    practice = study.practice_units(units, picked, ["unit"], 4, "x").collect()
    assert [r.position for r in practice] == [0, 1, 2, 3] and not {r.unit for r in practice} & set(first)


def test_empty_pool(spark):
    empty = pool(spark, [("a", "mid", 1)]).where("false")
    picked = study.quota_sample(empty, ["unit"], QUOTAS, BACK, "x")
    assert picked.collect() == [] and study.presentation(picked, ["unit"], 0.1, "x").collect() == [] and study.practice_units(empty, picked, ["unit"], 3, "x").collect() == []
