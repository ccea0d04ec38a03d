"""Identity of observations over time: galleries of entities that grow with every assignment.

Observations of one gallery (a movie and kind) are assigned in their order. Each passes a
funnel: entities it may be (``allowed``), static attributes that don't contradict, a fused
score of body, face and class at ``threshold`` or a strong face with a body not far below it, and, if asked
for, a least similarity to every member. The entity of the best fused score takes it, the earlier one of equals;
else it opens an entity. Without a body vector the name decides.

An entity is kept as sums of its vectors and their number, so a gallery grows with its
entities and not with its observations; only the least-similarity guard needs the members' vectors, and
they are kept only when it is on. The same step serves a batch (``assign``: a gallery at a time, its
observations sorted by Spark and read one after the other) and a stream
(``assign_stream``: the gallery is keyed state).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A strong face accepts a body this much below the threshold; a face alone never does.
RESCUE = 0.15
CUES = ("body", "face", "class")
WEIGHTS = {"body": 1.0, "face": 0.6, "class": 0.3}
FOUND = "entity long, is_new boolean, score double, face_score double, rejected array<long>"


@dataclass
class Funnel:
    """Settings of an assignment."""

    threshold: float
    face_strong: float = 0.5
    static_overlap: float = 0.75
    least: float | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


@dataclass
class Known:
    """One entity of a gallery."""

    name: str | None
    static: dict[str, str]
    sums: dict[str, list[float]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    members: list[list[float]] = field(default_factory=list)


def cosine(a, b) -> float:
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size > 0 else 0.0


def fused(cues: dict[str, float | None], weights: dict[str, float]) -> float | None:
    """Weighted mean of the cues that are there; null if none is."""
    there = {n: x for n, x in cues.items() if x is not None and weights.get(n, 0.0) > 0}
    total = sum(weights[n] for n in there)
    return sum(weights[n] * x for n, x in there.items()) / total if total > 0 else None


def lowered(static: dict | None) -> dict[str, str]:
    return {str(k).lower(): str(v).lower() for k, v in dict(static or {}).items()}


def agree(a: dict[str, str], b: dict[str, str], share: float) -> bool:
    """Whether ``share`` of the attributes that both have are equal; true where they share none."""
    both = a.keys() & b.keys()
    return not both or sum(a[k] == b[k] for k in both) / len(both) >= share


class Gallery:
    """Entities by number; ``take`` assigns one observation and remembers it."""

    def __init__(self, funnel: Funnel, known: list[Known] | None = None):
        self.funnel, self.known = funnel, known or []

    def take(self, name, static, allowed, vectors: dict[str, list[float] | None]) -> tuple:
        f, static = self.funnel, lowered(static)
        body = vectors.get("body")
        match, best, best_face, rejected = None, None, None, []
        if body is None:
            label = (name or "").strip().lower()
            match = next((n for n, e in enumerate(self.known) if (e.name or "").strip().lower() == label), None)
            if match is not None and not agree(static, self.known[match].static, f.static_overlap):
                match = None
        else:
            for n, entity in enumerate(self.known):
                if (allowed is not None and n not in allowed) or not agree(static, entity.static, f.static_overlap) or "body" not in entity.sums:
                    continue
                cues = {c: cosine(vectors[c], entity.sums[c]) if vectors.get(c) is not None and c in entity.sums else None for c in CUES}
                score = fused(cues, f.weights)
                if score is None:
                    continue
                rescued = cues["face"] is not None and cues["face"] >= f.face_strong and cues["body"] >= f.threshold - RESCUE
                if score < f.threshold and not rescued:
                    continue
                if f.least is not None and min(cosine(body, m) for m in entity.members) < f.least:
                    rejected.append(n)
                    continue
                if best is None or score > best:
                    match, best, best_face = n, score, cues["face"]
        is_new = match is None
        if is_new:
            match = len(self.known)
            self.known.append(Known(name, static))
        entity = self.known[match]
        if not entity.static:
            entity.static = static
        for c in CUES:
            v = vectors.get(c)
            if v is not None:
                v = [float(x) for x in v]
                old = entity.sums.get(c)
                entity.sums[c] = v if old is None else [a + b for a, b in zip(old, v, strict=True)]
                entity.counts[c] = entity.counts.get(c, 0) + 1
        if f.least is not None and body is not None:
            entity.members.append([float(x) for x in body])
        told = lambda x: None if x is None else round(x, 4)
        return match, is_new, told(best), told(best_face), rejected

    def stored(self) -> str:
        return json.dumps([asdict(e) for e in self.known])

    @classmethod
    def restored(cls, funnel: Funnel, text: str) -> Gallery:
        return cls(funnel, [Known(**e) for e in json.loads(text)])


COLUMNS = ["seq", "item", "name", "static", "allowed", *CUES]


def _some(x):
    """None for null, else the value (a pandas null may be a NaN)."""
    return None if x is None or (isinstance(x, float) and x != x) else x


def _walk(rows: pd.DataFrame, gallery: Gallery) -> list[tuple]:
    out = []
    for r in rows[COLUMNS].itertuples(index=False, name=None):
        _, item, name, static, allowed, *cues = r
        allowed = _some(allowed)
        given = {c: _some(v) for c, v in zip(CUES, cues, strict=True)}
        out.append((item, *gallery.take(_some(name), _some(static), None if allowed is None else set(allowed), given)))
    return out


def _with_all(observations: DataFrame, keys: list[str]) -> DataFrame:
    """The columns a walk reads; those that are not given are null."""
    types = {"name": "string", "static": "map<string,string>", "allowed": "array<long>"} | {c: "array<double>" for c in CUES}
    given = [F.col(c).cast(t).alias(c) if c in observations.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    return observations.select(*keys, F.col("seq").cast("long").alias("seq"), "item", *given)


def _schema(observations: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in observations.select(*keys, "item").schema) + f", {FOUND}"


def _frame(key: tuple, keys: list[str], rows: list[tuple]) -> pd.DataFrame:
    names = ["item", *(c.split()[0] for c in FOUND.split(", "))]
    out = pd.DataFrame(rows, columns=names)
    for k, v in zip(keys, key, strict=True):
        out.insert(0, k, v)
    return out[[*keys, *names]]


def assign(observations: DataFrame, keys: list[str], funnel: Funnel) -> DataFrame:
    """keys, item, entity (a number in its gallery, in order of opening), is_new, score, face_score, rejected (entities that the guard turned down).

    observations: keys, seq, item and any of name, static, allowed, body, face, class. A
    gallery's observations come sorted, batch by batch, so a task holds its entities and one batch of rows.
    """
    rows = _with_all(observations, keys)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gallery = None, Gallery(funnel)
        for frame in frames:
            same = frame[keys].astype(object).where(frame[keys].notna(), None)
            labels = list(same.itertuples(index=False, name=None))
            start = 0
            for end in range(1, len(labels) + 1):
                if end == len(labels) or labels[end] != labels[start]:
                    if labels[start] != at:
                        at, gallery = labels[start], Gallery(funnel)
                    yield _frame(at, keys, _walk(frame.iloc[start:end], gallery))
                    start = end

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "item")
    return ordered.mapInPandas(walk, _schema(observations, keys))


def assign_stream(observations: DataFrame, keys: list[str], funnel: Funnel) -> DataFrame:
    """The same for a stream: galleries are state, and each micro-batch is taken in its order after all before it."""
    rows = _with_all(observations, keys)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gallery = Gallery.restored(funnel, state.get[0]) if state.exists else Gallery(funnel)
        rows = pd.concat(frames).sort_values(["seq", "item"], na_position="first")  # the order of a micro-batch runs over all its frames
        found = _walk(rows, gallery)
        state.update((gallery.stored(),))
        yield _frame(key, keys, found)

    return rows.groupBy(*keys).applyInPandasWithState(step, _schema(observations, keys), "gallery string", "append", GroupStateTimeout.NoTimeout)
