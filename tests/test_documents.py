"""Faults of translated documents, each by a literal, and the walk of nested ones."""

import copy
import json

from pyspark.sql import functions as F

from tidemark.operators import documents

BASE = {
    "story_id": "lake_9", "segment_sec": 4, "title": "湖", "premise": "雨", "entities": {"boat": {"kind": "prop", "name": "小船", "appearance": "红色"}, "ada": {"kind": "character", "name": "阿达", "states": {"dry": "干", "wet": "湿"}}},
    "state_machines": {"ada": ["dry", "wet"]}, "lookalike_pairs": [{"pair": ["boat", "ada"], "features": {"boat": "长"}, "note": "像"}],
    "scenes": [{"id": "one", "setting": "岸", "present": ["boat", {"eid": "ada", "state": "dry", "count": 2, "anchor": {"type": "pronoun", "phrase": "她", "resolves_to": "ada"}}],
                "actions": ["她走。", {"action": "她跳。", "present": ["ada"], "events": [{"type": "transform", "eid": "ada", "to": "wet", "shown": True}]}]}],
}


def english():
    text = json.dumps(BASE, ensure_ascii=False)
    for zh, en in (("湖", "Lake"), ("雨", "Rain"), ("小船", "Skiff"), ("红色", "red"), ("阿达", "Ada"), ("干", "dry"), ("湿", "soaked"), ("长", "long"), ("像", "alike"), ("岸", "Shore"), ("她走。", "She walks."), ("她跳。", "She jumps."), ("她", "she")):
        text = text.replace(zh, en)
    return json.loads(text)


def table(spark, *docs):
    rows = [(i, None if d is None else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "id long, text string").select("id", F.parse_json("text").alias("doc"))


def changed(path, value):
    doc = copy.deepcopy(english())
    *way, last = path
    at = doc
    for step in way:
        at = at[step]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return doc


def test_every_fault_by_itself(spark):
    first = ["scenes", 0, "present", 1]
    cases = [
        (english(), set()),
        (changed(["story_id"], "lake_8"), {("identifier_changed", "story_id")}),
        (changed(["segment_sec"], None), {("identifier_changed", "segment_sec")}),
        (changed(["entities", "boat", "kind"], "location"), {("identifier_changed", "entities.boat.kind")}),
        (changed(["title"], "  \n"), {("empty_text", "title")}),
        (changed(["premise"], None), {("empty_text", "premise")}),
        (changed(["entities", "boat", "name"], 7), {("empty_text", "entities.boat.name")}),
        (changed(["entities", "ada", "name"], "Ada 阿"), {("not_translated", "entities.ada.name"), ("text_left", "")}),
        (changed(["_comment"], "注"), {("text_left", "")}),
        (changed(["entities", "ada", "states", "湿"], "x"), {("text_left", "")}),
        (changed(["entities", "oar"], {"kind": "prop"}), {("keys_changed", "entities")}),
        (changed(["state_machines", "ada"], ["dry"]), {("count_changed", "state_machines.ada")}),
        (changed(["lookalike_pairs", 0, "features"], {"ada": "long"}), {("keys_changed", "lookalike_pairs[0].features"), ("empty_text", "lookalike_pairs[0].features.boat")}),
        (changed(["lookalike_pairs", 0, "pair", 1], "boat"), {("identifier_changed", "lookalike_pairs[0].pair[1]")}),
        (changed([*first, "count"], 3), {("identifier_changed", "scenes[0].present[1].count")}),
        (changed([*first, "anchor", "resolves_to"], "boat"), {("identifier_changed", "scenes[0].present[1].anchor.resolves_to")}),
        (changed([*first, "anchor", "phrase"], ""), {("empty_text", "scenes[0].present[1].anchor.phrase")}),
        (changed([*first, "state"], "damp"), {("not_a_member", "scenes[0].present[1].state")}),
        (changed(["scenes", 0, "actions", 1, "events", 0, "to"], "damp"), {("not_a_member", "scenes[0].actions[1].events[0].to")}),
        (changed(["scenes", 0, "actions", 1, "events", 0, "shown"], False), {("identifier_changed", "scenes[0].actions[1].events[0].shown")}),
        (changed(["scenes", 0, "actions", 0], "走 on"), {("not_translated", "scenes[0].actions[0]"), ("text_left", "")}),
        (changed(["scenes", 0, "setting"], None), {("empty_text", "scenes[0].setting")}),
        (None, {("missing_document", "")}),
    ]
    found = {}
    for r in documents.differences(table(spark, *[BASE] * len(cases)), table(spark, *[d for d, _ in cases])).collect():
        found.setdefault(r.id, set()).add((r.code, r.path))
    for i, (_, want) in enumerate(cases):
        assert found.get(i, set()) == want, i


def slow_nodes(value, path="", parent=None):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "leaf"
    out = [(path, parent, kind)]
    for k, v in value.items() if kind == "object" else enumerate(value) if kind == "array" else ():
        step = f"{path}[{k}]" if kind == "array" else f"{path}.{k}" if path else k
        out += slow_nodes(v, step, path)
    return out


def test_nodes_of_deep_documents(spark):
    deep = leaf = {}
    for _ in range(9):
        leaf["x"] = [[{}], None, 1.5]
        leaf = leaf["x"][0][0]
    docs = [BASE, deep, [], 3, {"a": {}, "b": []}]
    got = {}
    for r in documents.nodes(table(spark, *docs, None)).collect():
        got.setdefault(r.id, []).append((r.path, r.parent, r.kind if r.kind in ("object", "array") else "leaf"))
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(slow_nodes(d), key=str) for i, d in enumerate(docs)}
