"""Secret scans over an incremental blob ledger (operator 6).

Every version of a text is a blob named by the SHA-256 of its bytes; a path (by
default a doc_id) may hold many versions, one row each. The ledger is a table in a folder that the cluster
shares: the findings of each (blob, rule version) ever scanned. A scan reads only
the blobs whose pair the ledger lacks, one copy of each, appends what it finds, and joins the findings
(old and new) back to every path that holds the blob. A run that dies before its append is
committed leaves the ledger as it was; what two runs scan at the same time is found twice and counts once.

Base rules: assign, access and hex. The method adds rules for well-known token
shapes; their spans are reported along with the base ones.

Edge cases: a null text is the empty blob; texts are scanned whole; copies share
one scan; a null path keeps its row; any number of versions may share a path (or have none); further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shared_folder

RULE_VERSION = "1"
#: Addresses that a task remembers in order to drop copies early; copies beyond them are dropped when the ledger is read.
REMEMBERED = 200_000
BASE = ("assign", "access", "hex")
FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I
)
KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MORE = {
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "payment": re.compile(r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
}
HINTS = {"forge": "gh", "chat": "xox", "payment": "k_", "web_token": "eyJ", "private_key": "-----BEGIN "}


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(rule, start, end) by start, then rule as listed; code points, end exclusive."""
    if not text:
        return []
    out = []
    if KEYWORD.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for rule, pattern in MORE.items():
        if HINTS[rule] in text:
            out += [(rule, *m.span()) for m in pattern.finditer(text)]
    order = (*BASE, *MORE)
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of a task's copies of each blob, while their addresses are few enough to remember."""
    seen: set[str] = set()
    for batch in batches:
        blobs = batch.column(0).to_pylist()
        first = []
        for blob in blobs:
            first.append(blob not in seen)
            if len(seen) < REMEMBERED:
                seen.add(blob)
        yield batch.filter(pa.array(first, pa.bool_()))


def _scan_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings of each blob that reaches the task, once."""
    seen: set[str] = set()
    for batch in batches:
        blobs, rows = [], []
        for blob, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if blob in seen:
                continue
            if len(seen) < REMEMBERED:
                seen.add(blob)
            spans = find_secrets(value.as_py())
            base = [s for s in spans if s[0] in BASE]
            blobs.append(blob)
            rows.append(
                (
                    *(sum(s[0] == k for s in base) for k in BASE),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(spans),
                )
            )
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(blobs, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            names=["blob", *(p.split()[0] for p in FINDINGS.split(", "))],
        )


LEDGER = f"blob string, rule_version string, {FINDINGS}"


def address(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """path, blob, text: every row with the content address of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col(path).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")
    )


class Ledger:
    """Findings of every (blob, rule version) scanned so far, as a table of Parquet files in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """What has been committed; an empty table before the first scan."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def known(self, rule_version: str) -> DataFrame:
        """Findings under a rule version, one row a blob."""
        return self.rows().where(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])

    def append(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in LEDGER.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.folder)


def scan_blobs(docs: DataFrame, ledger: Ledger, rule_version: str = RULE_VERSION, path: str = "doc_id") -> DataFrame:
    """path, blob and the findings of every row of ``docs``; pairs new to ``ledger`` are scanned and added to it."""
    rows = address(docs, path)
    paths = durable(rows.select("path", "blob"))
    unseen = paths.select("blob").distinct().join(ledger.known(rule_version).select("blob"), "blob", "left_anti")
    # One copy of each unseen blob: copies are thinned out where they lie, before anything is sent.
    one = rows.select("blob", "text").mapInArrow(_first_copies, "blob string, text string")
    fresh = durable(unseen).hint("shuffle_hash")
    scanned = one.join(fresh, "blob", "left_semi").mapInArrow(_scan_once, f"blob string, {FINDINGS}")
    ledger.append(scanned.withColumn("rule_version", F.lit(rule_version)))
    # Written out, so that the join can deal a hot blob's paths to many tasks.
    return paths.join(durable(ledger.known(rule_version)), "blob", "left")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a new ledger, so that every run reads every text."""
    ledger = Ledger(spark, f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}")
    rows = scan_blobs(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger)
    return rows.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"
    )


QUERIES = {"op6_secrets": op6_secrets}
