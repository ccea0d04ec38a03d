"""Conversation repair against a search over all edits, by (cost, audit)."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair

SF = "/root/testdata/sf0.001"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def slow_repair(rows):
    """(cost, audit, repaired lines) of rows (role, text, must go, truncated): the least of all edits, place by place."""
    best = {0: (0, "", [])}

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    step = NEXT.get((q, role[0]))
                    if step is not None:
                        offer = (cost + 3, audit + "I", [*lines, f"{role}:"])
                        if step not in states or offer[:2] < states[step][:2]:
                            states[step] = offer
        return states

    for role, text, gone, cut in rows:
        after = {}
        for q, (cost, audit, lines) in inserted(best).items():
            offers = [(q, (cost + 4, audit + "D", lines))]
            if not gone:
                offers.append((NEXT.get((q, role[:1])), (cost + 3 * cut, audit + "K", [*lines, f"{role}:{text}"])))
                offers += [(NEXT.get((q, r[0])), (cost + 3 + 3 * cut, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant")]
            for step, offer in offers:
                if step is not None and (step not in after or offer[:2] < after[step][:2]):
                    after[step] = offer
        best = after
    best = inserted(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def slow_row(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    counts, coded, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        coded.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, lines = slow_repair(coded)
    return (conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow_all(rows, damage=True):
    kept = {}
    for r in rows:
        kept.setdefault(r[0], [])
    for r in slow_damage(rows) if damage else [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]:
        kept[r[0]].append(r)
    return sorted((slow_row(c, rs) for c, rs in kept.items()), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CODES = st.lists(st.sampled_from([0, 1, 2, 3, 4, 6, 9, 10, 11]), max_size=12)


@settings(max_examples=500, deadline=None)
@given(CODES, st.sampled_from([1, 2, 5, 64]))
def test_layers_by_search(codes, width):
    """Cost and least audit of any rows, in one stretch or many."""
    old, repair.STRETCH = repair.STRETCH, width
    try:
        audit, state = repair.audit_over(bytes(codes), 0, repair.AT_END)
        audit += repair.end_audit(state)
        rows = [({0: "x", 1: "system", 2: "user", 3: "assistant"}[c & 3], str(k), bool(c & 4), bool(c & 8)) for k, c in enumerate(codes)]
        cost, want, lines = slow_repair(rows)
        assert audit == want
        assert repair.repaired(audit, 0, [r[:2] for r in rows]) == lines
        assert repair.chained(repair.costs_over(bytes(codes)), repair.AT_END)[0] == cost
    finally:
        repair.STRETCH = old


def test_known_conversations():
    code = {"s": 1, "u": 2, "a": 3}
    plan = lambda word: (lambda a, q: a + repair.end_audit(q))(*repair.audit_over(bytes(code[x] for x in word), 0, repair.AT_END))
    assert [plan(w) for w in ("", "ua", "sua", "uu", "au", "ss", "u", "s", "uaua")] == ["", "KK", "KKK", "KR", "IKKI", "KIR", "KI", "D", "KKKK"]


EDGE = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 7, "assistant", "no end"),
    (2, None, "user", "first"), (2, 3, None, None), (2, 3, "user", "\t \n"), (2, 4, "", "text."), (2, 5, "tool", "result!"),
    (None, 0, "user", "no id."), (None, None, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"),
    (3, None, None, "y."), (3, None, "user", "y."), (4, 2, "user", "Été ?   "), (4, 2, "unknown", "z." * 4000), (4, 9, "assistant", "ok.\x0b"),
]
SCHEMA = "conv_id long, turn long, role string, text string, copies string, part int, late string"


def table(spark, rows, parts):
    return spark.createDataFrame([(*r, "c", 1, "l") for r in rows], SCHEMA).repartition(parts)


def test_edge_cases(spark):
    lost = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [*EDGE, (lost, 0, "user", "dropped."), *((c, t, random.Random(c * 31 + t).choice(["user", "assistant"]), f"{t % 3}.") for c in range(10, 60) for t in range(c % 9))]
    for parts in (1, 3):
        assert found(repair.repair_conversations(repair.damaged(table(spark, rows, parts)))) == slow_all(rows)
        assert found(repair.repair_conversations(repair.untouched(table(spark, rows, parts)))) == slow_all(rows, damage=False)
    assert repair.repair_conversations(repair.damaged(table(spark, [], 1))).count() == 0
    text_ids = spark.createDataFrame([("a", 0, "user", "x."), (None, 1, "user", "y.")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id: r.audit for r in repair.repair_conversations(repair.untouched(text_ids)).collect()} == {"a": "KI", None: "KI"}


@pytest.mark.parametrize("parts", [4, 23])
def test_conversation_over_many_partitions(spark, parts):
    """One conversation holds most rows and lies in many range partitions, its rows partly equal."""
    rng = random.Random(parts)
    rows = [(5, t // 2, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["a.", "b", f"{t}.", f"{t}!", " "])) for t in range(700)]
    rows += [(c, t, rng.choice(["user", "assistant"]), f"{c}{t}.") for c in (1, 2, 8) for t in range(5)] + [(5, 7, "user", "again.")] * 90
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(repair.repair_conversations(repair.damaged(table(spark, rows, 3)))) == slow_all(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(repair.op13_repair(spark, SF)) == slow_all(rows)
