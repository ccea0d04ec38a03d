"""Language identification by hyperdimensional profiles (operator 8).

Every letter (lower-cased code point) has a random +1/-1 vector, drawn by a keyed hash; a three-letter gram is the product of its
letters' vectors, each permuted (rotated) by its place. A language's prototype is
the bundle (sum) of the gram vectors of its texts, each text with weight one, with
the mean of all languages removed. A document is the bundle of its own grams and
goes to the prototype of largest cosine.

Bundling is linear: a language's bundle is the sum over its grams' total weights, and a document's product with a prototype is the sum, over its
grams, of the gram vector's product with the prototype. A worker keeps those products
in a table of bounded size, so a document costs a look-up a gram.
Its norm, which does not change the order, uses the near-orthogonality of gram
vectors: sqrt(DIMENSIONS * sum of squared counts), right to a few hundredths for a text of some lines.

Prototypes are a table of one vector a language. They reach the tasks in blocks of ``LANGUAGES``, and a document's best
language and its sum of odds are carried from block to block, so any number of languages is told apart.

Edge cases: a null text or one without a letter is ``und`` with score 0; null
languages are not learned; if nothing can be learned every document is ``und``; of equal cosines the language first by code point wins;
texts are read whole; repeated rows are judged each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, hand_back

UNDECIDED = "und"
DIMENSIONS = 2048
#: Languages in one block of prototypes.
LANGUAGES = 1000
#: Bits of a code point in a gram's code.
BITS = 21
#: Softmax over cosines times this.
SHARPNESS = 20.0
#: Bytes of a worker's table of products, and (language, gram) weights that a task holds.
TABLE_BYTES = 1 << 25
WEIGHTS = 1 << 20


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The lower-cased letter of every code point of the first plane; 0 for what is no letter."""
    table = np.zeros(0x10000, dtype=np.int64)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    table = _symbols()
    if len(points) and points.max() >= 0x10000:
        wide = points >= 0x10000
        out = table[np.where(wide, 0, points)]
        out[wide] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in points[wide].tolist()]
        return out
    return table[points]


def grams(text: str | None) -> np.ndarray | None:
    """Codes of the three-letter grams of the text's words, gaps included; None without a letter."""
    if not text:
        return None
    s = symbols(text)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)  # one gap between words
    s = np.concatenate([[0], s[keep], [0]])
    if not s.any():
        return None
    codes = (s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:]
    return codes[s[1:-1] != 0]


@lru_cache(maxsize=4096)
def letter(point: int, seed: int = 7) -> np.ndarray:
    """The vector of a code point (0: a gap)."""
    return np.random.default_rng([seed, point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """(grams, dimensions): the letters of each gram bound together, the first rotated by two, the second by one."""
    out = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
    for shift in (2, 1, 0):
        points, at = np.unique(codes >> shift * BITS & (1 << BITS) - 1, return_inverse=True)
        out *= np.stack([np.roll(letter(p), shift) for p in points.tolist()])[at]
    return out


def _blocks(n: int, size: int = 2048) -> Iterator[slice]:
    return (slice(a, a + size) for a in range(0, n, size))


def _summed(codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(weights), len(found))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, weight: the task's sums, a text's weights adding up to one."""
    sums: dict[str, tuple[list, list]] = {}
    waiting = 0

    def told() -> pa.RecordBatch:
        found = [(lang, *_summed(*x)) for lang, x in sums.items()]
        names = pa.array([lang for lang, _, _ in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(g) for _, g, _ in found])))
        return pa.RecordBatch.from_arrays(
            [names, pa.array(np.concatenate([g for _, g, _ in found])), pa.array(np.concatenate([w for _, _, w in found]))],
            names=["lang", "gram", "weight"],
        )

    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = grams(value.as_py())
            if codes is None:
                continue
            found, counts = np.unique(codes, return_counts=True)
            held = sums.setdefault(lang, ([], []))
            held[0].append(found)
            held[1].append(counts / len(codes))
            waiting += len(found)
            if waiting >= WEIGHTS:
                sums = {k: tuple([x] for x in _summed(*v)) for k, v in sums.items()}
                waiting = sum(len(v[0][0]) for v in sums.values())
                if waiting >= WEIGHTS // 2:
                    yield told()
                    sums, waiting = {}, 0
    if sums:
        yield told()
    del sums
    hand_back()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, total, bundle: sums of weights and of weighted gram vectors of the rows (lang, gram, weight), by language."""
    for batch in batches:
        langs, at = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
        codes, weights = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        bundles = np.zeros((len(langs), DIMENSIONS))
        for some in _blocks(len(codes)):
            for k in np.unique(at[some]).tolist():
                of = np.flatnonzero(at[some] == k) + some.start
                bundles[k] += weights[of] @ gram_vectors(codes[of]).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.bincount(at, weights, len(langs))), pa.array(list(bundles), pa.list_(pa.float64()))],
            names=["lang", "total", "bundle"],
        )


def learn(docs: DataFrame) -> DataFrame:
    """lang, bundle (mean of its texts) of every language with a text that has a letter."""
    texts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    weights = texts.mapInArrow(_profile, "lang string, gram long, weight double").groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))
    parts = durable(weights.mapInArrow(_bundle, "lang string, total double, bundle array<double>"))
    totals = parts.groupBy("lang").agg(F.sum("total").alias("total"))
    places = parts.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    bundles = places.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("b"))  # DIMENSIONS entries
    mean = F.transform("b", lambda p: p["x"] / F.col("total"))
    return durable(bundles.join(totals, "lang").select("lang", mean.alias("bundle")))


def prototype_blocks(learned: DataFrame, size: int = LANGUAGES) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages in the order of code points with unit prototypes, ``size`` at a time; the mean of all languages is removed."""
    n = learned.count()
    if not n:
        return
    mean = learned.select(F.posexplode("bundle").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("x"))
    middle = np.zeros(DIMENSIONS)
    if n > 1:
        for r in mean.collect():  # DIMENSIONS rows
            middle[r.place] = r.x
    last = None
    while True:
        rest = learned if last is None else learned.where(F.col("lang") > last)
        rows = rest.orderBy("lang").limit(size).collect()
        if not rows:
            return
        last = rows[-1].lang
        bundles = np.array([r.bundle for r in rows]) - middle
        norms = np.linalg.norm(bundles, axis=1, keepdims=True)
        yield [r.lang for r in rows], (bundles / np.where(norms > 0, norms, 1)).astype(np.float32)


class Products:
    """Products of gram vectors with a block of prototypes; those met first are remembered, within ``TABLE_BYTES``."""

    def __init__(self, prototypes: np.ndarray):
        self.prototypes = prototypes
        self.codes = np.empty(0, dtype=np.int64)
        self.rows = np.empty((0, len(prototypes)), dtype=np.float32)
        self.limit = TABLE_BYTES // (8 + 4 * len(prototypes))

    def fresh(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([gram_vectors(codes[some]).astype(np.float32) @ self.prototypes.T for some in _blocks(len(codes))])

    def of(self, codes: np.ndarray) -> np.ndarray:
        """(grams, languages) for distinct codes in ascending order."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), dtype=bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        out = np.empty((len(codes), len(self.prototypes)), dtype=np.float32)
        out[known] = self.rows[at[known]]
        if not known.all():
            out[~known] = self.fresh(codes[~known])
            if len(self.codes) + len(codes) <= self.limit:
                self.rows = np.insert(self.rows, at[~known], out[~known], axis=0)
                self.codes = np.insert(self.codes, at[~known], codes[~known])
        return out


def cosines(codes: np.ndarray, products: Products) -> np.ndarray:
    found, counts = np.unique(codes, return_counts=True)
    n = counts.astype(np.float64)
    return n @ products.of(found) / np.sqrt(DIMENSIONS * (n * n).sum())


_TABLE: dict[str, Products] = {}


def _products(model: str, prototypes: np.ndarray) -> Products:
    """One table a worker process, for the model in use."""
    if model not in _TABLE:
        _TABLE.clear()
        _TABLE[model] = Products(prototypes)
    return _TABLE[model]


def _predictor(context, langs: list[str], prototypes: np.ndarray, last: bool):
    """A pass over the columns lang_pred, best and odds with one block of languages; the last one makes scores of them."""
    shared, model = context.broadcast((langs, prototypes)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        products = _products(model, prototypes)
        for batch in batches:
            names = batch.schema.names
            carried = (batch.column(names.index(c)).to_pylist() for c in ("lang_pred", "best", "odds"))
            columns: list[list] = [[], [], []]
            for value, lang, best, odds in zip(batch.column(names.index("text")), *carried, strict=True):
                codes = grams(value.as_py())
                if codes is not None and langs:
                    c = cosines(codes, products)
                    k = int(c.argmax())
                    top = max(best, float(c[k]))
                    odds = odds * np.exp(SHARPNESS * (best - top)) + float(np.exp(SHARPNESS * (c - top)).sum())
                    if c[k] > best:
                        lang, best = langs[k], float(c[k])
                    # odds are relative to the best cosine so far
                if last:
                    odds = 0.0 if best < -1 else min(1.0, 1.0 / odds)
                for column, x in zip(columns, (lang, best, odds), strict=True):
                    column.append(x)
            kept = [c for n, c in zip(names, batch.columns, strict=True) if n not in ("lang_pred", "best", "odds")]
            made = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*(n for n in names if n not in ("lang_pred", "best", "odds")), "lang_pred", "best", "odds"])
        batch = kept = made = carried = columns = None
        hand_back()

    return run


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 1 by 3; those rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _predicted(rows: DataFrame, learned: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """``rows`` with lang_pred and score."""
    context = rows.sparkSession.sparkContext
    out = rows.withColumns({"lang_pred": F.lit(UNDECIDED), "best": F.lit(-2.0), "odds": F.lit(0.0)})
    blocks = list_ahead(prototype_blocks(learned, languages))
    for (langs, prototypes), last in blocks:
        out = out.select(*rows.columns, "lang_pred", "best", "odds").mapInArrow(_predictor(context, langs, prototypes, last), _fields(out))
        if not last:
            out = durable(out)
    return out.select(*rows.columns, "lang_pred", F.col("odds").alias("score"))


def list_ahead(items: Iterator) -> Iterator[tuple]:
    """Each item with whether it is the last."""
    held = None
    for item in items:
        if held is not None:
            yield held, False
        held = item
    if held is not None:
        yield held, True


def _with_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.names.index("text"))
        yield batch.filter(pa.array([grams(v.as_py()) is not None for v in texts], pa.bool_()))


def identify(docs: DataFrame, keep: list[str], languages: int = LANGUAGES) -> DataFrame:
    """Columns ``keep`` (text among them) with lang_pred and score."""
    return _predicted(docs.select(*keep), learn(docs.where(~held_out())), languages)


def keep_identified(docs: DataFrame, min_score: float = 0.0, relabel: bool = False) -> DataFrame:
    """Documents with a letter and a score of ``min_score`` at least; a null lang is filled in.

    With ``relabel``, every lang becomes the one identified from the text. If no
    language can be learned, all documents with a letter stay as they are.
    """
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    learned = learn(docs.where(~held_out()))
    if learned.isEmpty():
        return rows.mapInArrow(_with_letters, _fields(rows))
    found = _predicted(rows, learned)  # only a text without a letter has score 0
    return found.where((F.col("score") > 0) & (F.col("score") >= min_score)).select(
        "doc_id", "text", (F.col("lang_pred") if relabel else F.coalesce("lang", "lang_pred")).alias("lang"), "source", "n_chars"
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language": op8_language}
