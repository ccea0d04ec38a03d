"""Prompts: appearance texts spliced in behind names, and names that an action leaves out."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVEALS = "array<struct<name:string,eid:string,text:string>>"
#: Automata that a task keeps; rosters repeat from segment to segment.
KEPT = 1_000


def reveal_text(op: Column, new_state: Column, states: Column, initial: Column, appearance: Column) -> Column:
    """What a segment shows of an entity: a transformed one its new state, a stateful one its initial state (else its first), any other its appearance.

    ``states``: array of (state, appearance) in the author's order. Full stops at the end are cut.
    """
    own = F.filter(states, lambda s: s["state"] == initial)
    first = F.when(F.size(own) > 0, F.get(own, F.lit(0))["appearance"]).otherwise(F.get(states, F.lit(0))["appearance"])
    text = F.when(op == "transform", new_state).when(F.size(states) > 0, first).otherwise(appearance)
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[。.]+$", "")


def revealed(op: Column) -> Column:
    """Operations at which an entity's looks are told."""
    return op.isin("introduce", "transform")


def places(text: str, names: list[str], automata: dict) -> dict[str, list[int]]:
    """Starts of every name in the text, in order; one pass over it for all names."""
    key = tuple(sorted({n for n in names if n}))
    if not key:
        return {}
    machine = automata.get(key)
    if machine is None:
        machine = ahocorasick.Automaton()
        for name in key:
            machine.add_word(name, name)
        machine.make_automaton()
        if len(automata) < KEPT:
            automata[key] = machine
    found: dict[str, list[int]] = {}
    for end, name in machine.iter(text):
        found.setdefault(name, []).append(end + 1 - len(name))
    return found


def splice(text: str, reveals: list[dict], automata: dict | None = None, before: str = "（", after: str = "）") -> tuple[str, list[str]]:
    """(the text with each reveal behind its name, eids of names that found no place).

    Longer names choose first, of equals the one given first; each takes its first place that no chosen
    name overlaps. Inserted texts are never searched.
    """
    automata = {} if automata is None else automata
    found = places(text, [r["name"] or "" for r in reveals], automata)
    taken = bytearray(len(text))
    inserts, missing = [], []
    for r in sorted(reveals, key=lambda r: -len(r["name"] or "")):
        name = r["name"] or ""
        at = next((i for i in found.get(name, ()) if not any(taken[i : i + len(name)])), None)
        if at is None:
            missing.append(r["eid"])
            continue
        taken[at : at + len(name)] = b"\x01" * len(name)
        inserts.append((at + len(name), f"{before}{r['text'] or ''}{after}"))
    out, last = [], 0
    for place, told in sorted(inserts):
        out += [text[last:place], told]
        last = place
    return "".join([*out, text[last:]]), missing


def _splicer(before: str, after: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict = {}
        for batch in batches:
            action, reveals = (batch.column(c).to_pylist() for c in ("action", "reveals"))
            done = [splice(a or "", [r for r in rs or [] if r], automata, before, after) for a, rs in zip(action, reveals, strict=True)]
            keep = [c for c in batch.schema.names if c not in ("action", "reveals")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([p for p, _ in done], pa.string()), pa.array([m for _, m in done], pa.list_(pa.string()))], names=[*keep, "prompt", "missing"]
            )

    return run


def rendered(segments: DataFrame, keys: list[str], before: str = "（", after: str = "）") -> DataFrame:
    """keys, prompt, missing: every segment's action with its reveals spliced in.

    segments: keys, action, reveals (name, eid, text). A null action is empty.
    """
    rows = segments.select(*keys, "action", F.col("reveals").cast(REVEALS).alias("reveals"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", prompt string, missing array<string>"
    return rows.mapInArrow(_splicer(before, after), schema)


def plain_name(text: Column) -> Column:
    """Lower case, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def names_it(action: Column, name: Column) -> Column:
    """Whether an action holds a name; one of Latin letters and digits only as whole words."""
    hay, needle = plain_name(action), plain_name(name)
    whole = F.concat(F.lit("(?<![a-z0-9])"), needle, F.lit("(?![a-z0-9])"))
    return F.when(needle == "", F.lit(False)).when(needle.rlike(r"^[a-z0-9][a-z0-9 _'-]*$"), F.regexp_like(hay, whole)).otherwise(F.contains(hay, needle))


def missing_names(segments: DataFrame, roster: DataFrame, keys: list[str], story: str) -> DataFrame:
    """keys, eid, name, reason: present entities whose roster name is empty or not in the action; each entity once a segment.

    segments: keys (with ``story``), action, present. roster: story, eid, name.
    """
    each = segments.select(*keys, "action", F.explode(F.array_distinct("present")).alias("eid")).where("eid <> ''")
    met = each.join(roster.select(story, "eid", F.trim("name").alias("name")), [story, "eid"], "left")
    name = F.coalesce("name", F.lit(""))
    reason = F.when(name == "", "empty_canonical_name").when(~names_it(F.col("action"), name), "action_missing_canonical_name")
    return met.select(*keys, "eid", name.alias("name"), reason.alias("reason")).where("reason is not null")
