"""Quality counts, personal data and secrets against plain readings of their definitions."""

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii, quality, secrets
from tidemark.llm.common import WordHash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.text(alphabet="ab 1234567890.-+()@_=:%é\n\t\x1c\u00a0AKIAtoken'\"ffsecretpassword/#<", max_size=160)


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 3))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\t\x1c#<é", max_size=60))
def test_counts(text):
    assert quality.text_counts(text.encode(), WordHash()) == slow_counts(text)


def test_quality_edge_cases(edge_docs, no_docs):
    rows = quality.quality_filter(edge_docs, min_group=3).collect()
    source = edge_docs.collect()
    assert len(rows) == len(source)
    want = sorted((r.doc_id if r.doc_id is not None else -1, *slow_counts(r.text)[:4]) for r in source if not r.text or len(r.text) < 3000)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in rows)
    assert set(want) <= set(got)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_filter(no_docs).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "a", 1) for i in range(300)]
    junk = [(900 + i, " ".join(f"w##{i}x{j}###" for j in range(80)), "en", "a", 1) for i in range(5)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.quality_filter(docs).where("kept").collect()}
    assert kept == set(range(300))
    # A source that is all symbols sets thresholds of its own.
    own = [(i, " ".join(f"w##{i}x{j}###" for j in range(80)), "en", "b", 1) for i in range(300)]
    assert quality.quality_filter(spark.createDataFrame(own, docs.schema)).where("kept").count() == 300
    # Beyond the broadcast bound the thresholds are joined by shuffle, with the same result.
    assert {r.doc_id for r in quality.quality_filter(docs, broadcast_groups=0).where("kept").collect()} == kept


@pytest.mark.parametrize("n_junk", [16, 45, 90, 130])
def test_quality_drops_junk_that_is_common_in_a_source(spark, n_junk):
    """5 to 30 % of a source: tables with a bar every few words, and words with symbols attached."""
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "a", 1) for i in range(300)]
    tables = [(1000 + i, " ".join("|" if j % 3 == 2 else f"cell{j}x" for j in range(90)), "en", "a", 1) for i in range(n_junk // 2)]
    attached = [(2000 + i, " ".join(f"word{j}###" for j in range(80)), "en", "a", 1) for i in range(n_junk - n_junk // 2)]
    docs = spark.createDataFrame(clean + tables + attached, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in quality.quality_filter(docs).where("kept").collect()} == set(range(300))


def slow_quantile(values, p):
    """The value of the cell of the smallest value with that share of all below or at it."""
    v = sorted(values)
    x = max(v[max(0, math.ceil(p * len(v) - 1e-9) - 1)], quality.LEAST)
    cell = math.ceil(math.log(x) / math.log(quality.GROWTH))
    return 0.0 if cell <= math.ceil(math.log(quality.LEAST) / math.log(quality.GROWTH)) else quality.GROWTH**cell * 2 / (1 + quality.GROWTH)


def test_quality_verdicts_by_brute_force(spark):
    """Fences and verdicts from plain quantiles; the same in any order and partitioning."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [sorted(map(tuple, quality.quality_filter(d, min_group=30).collect()), key=repr) for d in (docs, docs.repartition(7).orderBy("n_chars"))]
    assert runs[0] == runs[1]
    floors = {"symbol_ratio": 0.005, "line_ratio": 0.03, "repeat_ratio": 0.05, "word_length": 0.5}
    rows = quality.quality_filter(docs, min_group=30).collect()
    groups = {}
    for r in rows:
        if not r.base_failed:
            for key in ((r.lang, r.source), (r.lang,), ()):
                groups.setdefault(key, []).append(r)
    fences = {}
    for key, members in groups.items():
        for name, floor in floors.items():
            x = [r[name] for r in members]
            assert abs(slow_quantile(x, 0.5) - sorted(x)[math.ceil(len(x) / 2) - 1]) <= 0.0101 * slow_quantile(x, 0.5) + 1e-6
            a, b, c = (slow_quantile(x, p) for p in (0.25, 0.5, 0.75))
            fences[key, name] = (b + 6 * max(2 * (b - a), 0.1 * b, floor), a - 6 * max(c - a, floor))
    for r in rows:
        sound = not r.base_failed
        for name in floors if sound else ():
            key = next(k for k in ((r.lang, r.source), (r.lang,), ()) if len(groups.get(k, ())) >= 30)
            hi, lo = fences[key, name]
            sound &= r[name] <= hi * (1 + 1e-12) and (name != "word_length" or r[name] >= lo)
        assert r.kept == sound


def test_quality_labels(spark):
    """Labelled documents of sf0.01: the sound ones that pass the base rules stay, the junk goes."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_filter(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(labels, "doc_id").collect()
    assert {r.quality for r in rows} == {0, 1}
    assert all(r.kept == (r.quality == 1) for r in rows)


def slow_pii(text):
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    out = []
    for kind, pattern, test in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if test(m[0])]
    return out


@settings(max_examples=500, deadline=None)
@given(TEXTS | st.text(alphabet="a@.b-+1 ", max_size=40) | st.text(alphabet="0123456789 -", max_size=60))
def test_pii_base(text):
    found = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE]
    assert found == slow_pii(text)


def test_long_runs_of_digits():
    """Longer than int() reads: leading zeros don't count, other digits are too many."""
    assert [s[:3] for s in pii.find_spans("0" * 5000 + ".1.1.1")] == [("ip", 0, 5006)]
    assert not [s for s in pii.find_spans("9" * 5000 + ".1.1.1 1.1.1." + "8" * 6000) if s[0] == "ip"]


def test_pii_kinds():
    text = "Pay to IBAN GB82 WEST 1234 5698 7654 32 today, card 4111 1111 1111 1111, ssn 123-45-6789, mail a.b@c.org, 10.0.0.1, +1 (523) 555-1055"
    kinds = [s[0] for s in pii.find_spans(text)]
    assert kinds == ["email", "ip", "card", "phone", "iban", "national_id"]
    assert not [s for s in pii.find_spans("GB82 WEST 1234 5698 7654 33 and 123-45-6789") if s[0] in ("iban", "national_id") and s[0] == "iban"]
    assert pii.redact("x a.b@c.org y", pii.find_spans("x a.b@c.org y")) == "x <EMAIL> y"


def test_pii_edge_cases(edge_docs, no_docs):
    rows = pii.detect_pii(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty for r in rows if r.doc_id in (27, 28, 29))
    scrubbed = pii.scrub(edge_docs)
    assert scrubbed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and scrubbed.count() == len(rows)
    assert pii.detect_pii(no_docs).count() == 0 and pii.scrub(no_docs).count() == 0


def test_scrub_by_plain_replacement(spark):
    texts = ["plain prose stays", "mail a.b@c.org now, or d@e.net", "", None, "host 10.0.0.1 and a.b@c.org"]
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    got = pii.scrub(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    want = [t and re.sub(r"[a-z.]+@[a-z]+\.[a-z]+", "<EMAIL>", t).replace("10.0.0.1", "<IP>") for t in texts]
    assert sorted(tuple(r) for r in got) == [(i, t, "en", None, None if t is None else len(t)) for i, t in enumerate(want)]


def slow_secrets(text):
    out = []
    for k, (kind, pattern, test) in enumerate(
        (
            ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
            ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
        )
    ):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if test(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.sampled_from(["token", "Secret", " ", "=", ": ", "'", "abcdef0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "password", "api_key", "x", "\n"]), max_size=14).map("".join)
)
def test_secrets_base(text):
    assert [s for s in secrets.find_secrets(text) if s[0] in secrets.BASE] == slow_secrets(text)


def test_ledger_scans_only_new_pairs(spark, edge_docs, no_docs, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.rows().count() == 0
    blobs = lambda df: {r.blob for r in secrets.address(df).select("blob").distinct().collect()}
    texts = {r.blob: r.text for r in secrets.address(edge_docs).collect()}
    rows = secrets.scan_blobs(edge_docs, ledger).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.spans == secrets.joined(secrets.find_secrets(texts[r.blob])) for r in rows)
    assert {r.blob for r in ledger.rows().collect()} == blobs(edge_docs) and ledger.rows().count() == len(blobs(edge_docs))
    # Several versions of a path, and of no path; one known, the others new.
    versions = [(1, "AKIA" + "Q" * 16), (1, "token: abcdefghijkl1"), (1, None), (None, "0123456789abcdef"), (None, "nothing"), (7, "AKIA" + "Q" * 16)]
    fresh = spark.createDataFrame(versions, "doc_id long, text string")
    before = ledger.rows().count()
    found = secrets.scan_blobs(edge_docs.select("doc_id", "text").unionByName(fresh), ledger)
    assert found.count() == edge_docs.count() + len(versions)
    added = blobs(fresh) - blobs(edge_docs)
    assert ledger.rows().count() == before + len(added) == before + 4
    hits = {(r.path, r.n_access, r.n_assign, r.n_hex) for r in found.collect() if r.n_access or r.n_assign or r.n_hex}
    assert {(1, 1, 0, 0), (1, 0, 1, 0), (7, 1, 0, 0), (None, 0, 0, 1)} <= hits
    secrets.scan_blobs(fresh, ledger).collect()  # nothing new, nothing added
    assert ledger.rows().count() == before + 4
    secrets.scan_blobs(fresh, ledger, rule_version="2").collect()
    assert ledger.known("2").count() == len(blobs(fresh)) and ledger.known("1").count() == before + 4
    assert secrets.scan_blobs(no_docs, ledger).count() == 0


def test_many_versions_without_a_path(spark, tmp_path):
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('text ', id % 1000) text")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    assert secrets.scan_blobs(docs, ledger).count() == 3000 and ledger.rows().count() == 1000


def test_pii_goes_by_few_rows():
    """However many rows a batch has, a worker holds the texts of a few at a time."""
    import pyarrow as pa

    texts = [f"mail a{i}@example.org" if i % 3 else None for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(pii._scanner(0.5, rewrite=True)(iter([batch, batch.slice(0, 0), batch.slice(0, 7)])))
    assert max(map(len, parts)) <= 1024
    table = pa.Table.from_batches(parts)
    assert table["doc_id"].to_pylist() == [*range(5000), *range(7)]
    assert table["text"].to_pylist() == [t and "mail <EMAIL>" for t in texts + texts[:7]]
