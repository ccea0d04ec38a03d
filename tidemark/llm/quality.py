"""Quality rules with thresholds from quantile sketches (operator 3).

One pass takes the counts of a text. Quantile sketches of four ratios are built for
each (language, source), merged up to each language and to the whole table, and
the thresholds read from them are joined to the documents. A sketch is a histogram
over cells that grow by a constant factor, so a quantile is right to ``ACCURACY`` of its value,
sketches merge by adding their counts, and the same documents give the same thresholds in any order and partitioning. A group with fewer
than ``min_group`` documents borrows its language's sketch, a small language
the table's: sketches merge, so that costs no further pass.

Edge cases: a null or empty text has no words and fails the base rules; null
language or source is a group of its own; further columns are ignored; an empty
table gives no rows; repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHash, binary, durable, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
TAILS = bytes(range(0x80, 0xC0))
#: Upper fences are drawn for these; mean word length gets a lower one as well.
RATIOS = ("symbol_ratio", "line_ratio", "repeat_ratio", "word_length")
#: A sketch's quantiles are right to this share of their value; cells grow by a factor of GROWTH from LEAST on.
ACCURACY = 0.01
GROWTH = (1 + ACCURACY) / (1 - ACCURACY)
LEAST = 1e-6
#: A spread is at least this share of the median.
RELATIVE = 0.1
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(raw: bytes | None, table: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text.

    Three-word windows are compared by 64-bit hashes.
    """
    if not raw:
        return 0, 0, 0, 0, 0
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, SPACES + TAILS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    repeats = 0
    if n > 3:
        keys = window_hashes(word_hashes(words, table), 3)
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        if same.any():
            again = np.zeros(len(keys), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for j in range(3):
                covered[j : j + len(keys)] |= again
            repeats = int(covered.sum())
    return n, chars, symbols, dup_lines, repeats


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordHash()
    for batch in batches:
        rows = [text_counts(raw, table) for raw in binary(batch.column(0))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], *(pa.array(c, pa.int64()) for c in columns)],
            names=["doc_id", "lang", "source", *(p.split()[0] for p in COUNTS.split(", "))],
        )


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every document."""
    types = dict(docs.dtypes)
    schema = f"doc_id {types['doc_id']}, lang string, source string, {COUNTS}"
    return docs.select(
        "text", "doc_id", F.col("lang").cast("string"), F.col("source").cast("string")
    ).mapInArrow(_count_batches, schema)


def _ratios(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_ratio": F.col("n_symbols") / chars,
            "line_ratio": F.col("n_dup_lines") / words,
            "repeat_ratio": F.col("n_repeat_words") / words,
            "word_length": F.col("word_chars") / words,
        }
    )


def _cell(x: Column) -> Column:
    """The sketch cell of a ratio; values below ``LEAST`` share one."""
    return F.ceil(F.log(F.greatest(x, F.lit(LEAST))) / F.lit(math.log(GROWTH))).cast("int")


def _value(cell: Column) -> Column:
    """The value that stands for a cell, at most ``ACCURACY`` from all in it; zero for the lowest."""
    lowest = math.ceil(math.log(LEAST) / math.log(GROWTH))
    return F.when(cell <= lowest, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), cell) * (2 / (1 + GROWTH)))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, cell, n: the sketches of the four ratios as rows, a few hundred for each key and ratio."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ratio"), _cell(F.col(c)).alias("cell")) for i, c in enumerate(RATIOS)]))
    return rows.select(*keys, each.alias("x")).groupBy(*keys, "x.ratio", "x.cell").agg(F.count(F.lit(1)).alias("n"))


def quantiles(cells: DataFrame, keys: list[str], at=(0.25, 0.5, 0.75)) -> DataFrame:
    """keys, ratio, n and q25, q50, q75: for each sketch the value of the first cell with that share of the counts below or in it."""
    merged = cells.groupBy(*keys, "ratio", "cell").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "ratio")  # a sketch, not the documents
    upto = F.sum("n").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"upto": upto, "total": F.sum("n").over(of), "value": _value(F.col("cell"))})
    return ranked.groupBy(*keys, "ratio").agg(
        F.max("total").alias("n"),
        *[F.min(F.when(F.col("upto") >= F.lit(p) * F.col("total"), F.col("value"))).alias(f"q{round(100 * p)}") for p in at],
    )


def _fences(cells: DataFrame, keys: list[str], min_group: int, reach: float, floors: dict[str, float]) -> DataFrame:
    """Upper (and lower) limit of each ratio from the sketches of ``min_group`` documents or more.

    Upper limits rest on the median and the lower quartile alone, so that junk
    does not move them while it is less than half of a group.
    """
    found = quantiles(cells, keys).where(F.col("n") >= min_group)
    floor = F.element_at(F.array(*[F.lit(floors[r]) for r in RATIOS]), F.col("ratio") + 1)
    spread = F.greatest(2 * (F.col("q50") - F.col("q25")), RELATIVE * F.col("q50"), floor)
    low = F.col("q25") - reach * F.greatest(F.col("q75") - F.col("q25"), floor)
    found = found.withColumns({"hi": F.col("q50") + reach * spread, "lo": low})
    limits = {f"{r}_hi": ("hi", i) for i, r in enumerate(RATIOS)} | {"word_length_lo": ("lo", RATIOS.index("word_length"))}
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("ratio") == i, F.col(c))).alias(name) for name, (c, i) in limits.items()])


def thresholds(
    rows: DataFrame, min_group: int, reach: float, floors: dict[str, float]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fences of each (lang, source), each lang and of all documents that pass the base rules."""
    cells = durable(sketches(rows.where(~F.col("base_failed")), ["lang", "source"]))
    return (
        _fences(cells, ["lang", "source"], min_group, reach, floors),
        _fences(cells, ["lang"], min_group, reach, floors),
        _fences(cells, [], 1, reach, floors),
    )


def quality_filter(
    docs: DataFrame,
    min_group: int = 200,
    reach: float = 6.0,
    floors: dict[str, float] | None = None,
    broadcast_groups: int = 100_000,
) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of every document.

    ``reach``: how many spreads (twice the distance from lower quartile to
    median, at least the ratio's entry in ``floors`` and a tenth of the median)
    beyond the median a ratio may lie; word length may lie as many quartile
    distances below its lower quartile. Thresholds are
    broadcast only while there are at most ``broadcast_groups`` rows of them, languages and groups
    apart; beyond that they are joined by shuffle.
    """
    floors = floors or {
        "symbol_ratio": 0.005, "line_ratio": 0.03, "repeat_ratio": 0.05, "word_length": 0.5
    }
    rows = _ratios(durable(count_texts(docs)))
    by_group, by_lang, whole = map(durable, thresholds(rows, min_group, reach, floors))
    names = [f"{r}_hi" for r in RATIOS] + ["word_length_lo"]
    near = lambda df: F.broadcast(df) if df.count() <= broadcast_groups else df
    key = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    rows = rows.withColumns({"k_lang": key("lang"), "k_source": key("source")})
    for level, df, on in (
        ("g", by_group, ["k_lang", "k_source"]),
        ("l", by_lang, ["k_lang"]),
        ("w", whole, []),
    ):
        have = {f"k_{c}": key(c) for c in ("lang", "source") if f"k_{c}" in on}
        side = df.select(
            *[c.alias(k) for k, c in have.items()], *[F.col(n).alias(f"{level}_{n}") for n in names]
        )
        if on:
            rows = rows.join(near(side), on, "left")
        else:  # one row
            rows = rows.join(F.broadcast(side), F.lit(True), "left")
    limit = {n: F.coalesce(*(F.col(f"{level}_{n}") for level in "glw")) for n in names}
    sound = F.lit(True)
    for r in RATIOS:
        sound = sound & F.coalesce(F.col(r) <= limit[f"{r}_hi"], F.lit(True))
    sound = sound & F.coalesce(F.col("word_length") >= limit["word_length_lo"], F.lit(True))
    return rows.select(
        "doc_id", "lang", "source", *[p.split()[0] for p in COUNTS.split(", ")], *RATIOS,
        "base_failed", (~F.col("base_failed") & sound).alias("kept"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_filter(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "symbol_ratio", "line_ratio", "repeat_ratio", "word_length",
    )


QUERIES = {"op3_quality": op3_quality}
