"""Personal data: regular expressions propose, validators confirm, context scores (operator 4).

Base kinds (email, ip, card, phone) are kept wherever their pattern and validator
hold. The method adds two kinds: ``iban`` (country, check digits, mod-97) and
``national_id`` (three, two and four digits, or nine in a row, neither part all
zeros). A proposed span scores by kind, gains when its checksum holds and when a
context word stands within ``CONTEXT`` characters, and is reported from
``threshold`` on. Base spans are always reported.

Patterns are applied so that they take linear time on any text; the results are
those of a leftmost non-overlapping search.

Edge cases: a null or empty text has no spans; texts are read whole; repeated rows
are scanned each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hand_back

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
CONTEXT = 60
#: Rows whose texts a worker holds as Python objects at a time.
ROWS = 1024
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run matches from its start on or not at all, so a look-behind skips its other positions.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9+-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?![0-9-])")
WORDS = {
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte|swift|bic)\b", re.I),
    "national_id": re.compile(r"\b(?:ssn|social security|national id|tax id|passport|nif|dni)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def near(kind: str, text: str, start: int, end: int) -> bool:
    return bool(WORDS[kind].search(text[max(0, start - CONTEXT) : end + CONTEXT]))


def ibans(text: str) -> Iterator[tuple[int, int, float]]:
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        end = m.end()
        good = 15 <= len(plain) <= 34 and mod97(plain)
        if not good and " " in m[0]:  # the last groups may be words of the sentence
            parts = m[0].split(" ")
            for k in range(len(parts) - 1, 0, -1):
                plain = "".join(parts[:k])
                if 15 <= len(plain) <= 34 and mod97(plain):
                    good, end = True, m.start() + len(" ".join(parts[:k]))
                    break
        yield m.start(), end, 0.2 + 0.5 * good + 0.3 * near("iban", text, m.start(), end)


def national_ids(text: str) -> Iterator[tuple[int, int, float]]:
    for m in NATIONAL.finditer(text):
        d = m[0].replace("-", "")
        sound = d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        if sound:
            dashed = "-" in m[0]
            yield m.start(), m.end(), 0.2 + 0.35 * dashed + 0.4 * near("national_id", text, *m.span())


def find_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive."""
    if not text:
        return []
    out: list[tuple[str, int, int, float]] = []
    if "@" in text:
        out += [("email", a, b, 1.0) for a, b in emails(text)]
    out += [("ip", a, b, 1.0) for a, b in ips(text)]
    out += [("card", a, b, 1.0) for a, b in cards(text)]
    if "+" in text:
        out += [("phone", a, b, 1.0) for a, b in phones(text)]
    out += [("iban", a, b, s) for a, b, s in ibans(text) if s >= threshold]
    out += [("national_id", a, b, s) for a, b, s in national_ids(text) if s >= threshold]
    return out


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, last = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _scanner(threshold: float, rewrite: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = kept = columns = texts = None
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
            texts, rows = [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = find_spans(text, threshold)
                base = [s for s in spans if s[0] in BASE]
                counts = [sum(s[0] == k for s in base) for k in BASE]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(spans)))
                texts.append(redact(text, spans) if rewrite else None)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kept = [
                pa.array(texts, pa.string()) if n == "text" else c
                for n, c in zip(batch.schema.names, batch.columns, strict=True)
                if rewrite or n != "text"
            ]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[n for n in batch.schema.names if rewrite or n != "text"] + FOUND,
            )
        del batch, kept, columns, texts
        hand_back()

    return scan


FOUND = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def detect_pii(docs: DataFrame, threshold: float = 0.5, rewrite: bool = False) -> DataFrame:
    """The columns of ``docs`` (doc_id and text at least) and what was found.

    With ``rewrite``, ``text`` is returned with its spans redacted; otherwise only
    ``doc_id`` is carried along.
    """
    df = docs if rewrite else docs.select("doc_id", "text")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if rewrite or f.name != "text"]
        + [f"{n} long" for n in FOUND[:4]] + [f"{n} string" for n in FOUND[4:]]
    )
    return df.mapInArrow(_scanner(threshold, rewrite), schema)


def scrub(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data redacted and ``n_chars`` of the new text; no row is dropped."""
    done = detect_pii(docs.select("doc_id", "text", "lang", "source", "n_chars"), threshold, rewrite=True)
    return done.select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_pii": op4_pii}
