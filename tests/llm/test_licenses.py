"""License notices: base places by a plain search, alignments by trying every offset."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_base(text):
    words = split(text)
    out = []
    for phrase, label in PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out)


def slow_labels(text, weight, threshold=0.6, slack=2):
    """Every offset of every template, checked word by word."""
    words, out = split(text), {}

    def near(i, phrase):
        return any(words[k : k + len(phrase)] == phrase for k in range(max(0, i - slack), i + slack + 1))

    for label, notice, keys in licenses.TEMPLATES:
        n = notice.split()
        at = {k: [j for j in range(len(n)) if n[j : j + len(k.split())] == k.split()] for k in keys}
        for o in range(-len(n), len(words)):
            if all(any(near(o + j, k.split()) for j in js) for k, js in at.items()):
                score = sum(weight[w] for j, w in enumerate(n) if near(o + j, [w])) / sum(weight[w] for w in n)
                if score >= threshold:
                    out[label] = max(out.get(label, 0), score)
    return out


def index_of(texts):
    held = [set(split(t)) for t in texts]
    plain = licenses.Index(licenses.TEMPLATES, licenses.BASE, {}, 0)
    frequency = {w: sum(w.decode() in h for h in held) for w in plain.vocabulary}
    return licenses.Index(licenses.TEMPLATES, licenses.BASE, frequency, len(texts)), {w.decode(): 1 + math.log((1 + len(texts)) / (1 + n)) for w, n in frequency.items()}


PIECES = ["the", "license", "MIT", "cc", "BY-NC", "by", "gnu", "general public", "License,", "version", "3", "2.0", "all rights", "reserved.", "apache", "under", "released", "licensed", "é", "\x00", "x", "\n"]
NOTICES = [notice for _, notice, _ in licenses.TEMPLATES]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES + NOTICES), max_size=14).map(" ".join))
def test_words_base_and_labels(text):
    words = licenses.words_of(text.encode())
    assert [w.decode() for w in words] == split(text)
    index, weight = index_of(["the license of the public domain", "released under the sun", "all of the rights", text])
    base, found = index.matches(words, 0.6)
    assert base == slow_base(text)
    assert {m[0] for m in found} <= set(slow_labels(text, weight))
    for label, first, end, score in found:
        assert 0 <= first < end <= len(words) and 0.6 <= score <= 1


def test_every_notice_is_found():
    """Whole, with another word put in, with a word left out, and none of them without its key phrases."""
    index, weight = index_of(["the of and to in is this", *NOTICES])
    for label, notice, keys in licenses.TEMPLATES:
        held = lambda text: {m[0] for m in index.matches(licenses.words_of(text.encode()), 0.6)[1]}
        assert label in held(f"some code. {notice.upper()}; more code")
        first = notice.split()[0]
        if not any(k.startswith(first) for k in keys):
            assert label in held(notice.split(" ", 1)[1]) or slow_labels(notice.split(" ", 1)[1], weight).get(label) is None
            assert label in held(f"{first} indeed {notice.split(' ', 1)[1]}")
        broken = notice.replace(keys[0], " ".join(reversed(keys[0].split())))
        if len(keys[0].split()) > 1:
            assert label not in held(broken)


def test_lookup_reaches_every_template():
    """However many rare words a file holds, each template is met by the rarest of its own."""
    index, _ = index_of(NOTICES)
    everything = "\n\n\n\n filler filler filler ".join(NOTICES)
    assert {m[0] for m in index.matches(licenses.words_of(everything.encode()), 0.9)[1]} == {label for label, *_ in licenses.TEMPLATES}
    met = index.lookups(set(index.vocabulary), set(range(len(NOTICES))))
    for t, notice in enumerate(NOTICES):
        own = sorted({w.encode() for w in notice.split()}, key=lambda w: (-index.weight[w], w))
        assert {w for w, _ in met[t]} == set(own[: licenses.DEPTH])


def test_long_repetitive_text():
    index, _ = index_of(["x"])
    base, found = index.matches(licenses.words_of(b"license mit " * 20_000 + b"released under the mit license " * 3), 0.6)
    assert not base and {m[0] for m in found} == {"mit"}


def slow_row(r, weight):
    base = slow_base(r.text)
    own = {x for _, x in base}
    found = slow_labels(r.text, weight)
    score = 1.0 if base else max(found.values(), default=0.0)
    ends = (base[0][0], base[-1][0]) if base else (None, None)
    return (r.doc_id, len(split(r.text)), len(base), *ends, ",".join(sorted(own)), ",".join(sorted(own | set(found)))), score


def compared(docs):
    rows = docs.collect()
    _, weight = index_of([r.text for r in rows])
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels), r.score) for r in licenses.scan_licenses(docs).collect() if r.doc_id is not None)
    want = sorted(slow_row(r, weight) for r in rows if r.doc_id is not None)
    assert [g for g, _ in got] == [w for w, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(got, want, strict=True))
    return got


def test_edge_cases(spark, edge_docs, no_docs):
    assert licenses.scan_licenses(edge_docs).count() == edge_docs.count()
    compared(edge_docs.where("length(text) < 3000 or text is null"))
    assert licenses.scan_licenses(no_docs).count() == 0
    none = licenses.scan_licenses(edge_docs.where("text is null or text = ''")).collect()
    assert none and all((r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) == (0, 0, None, "", "", 0.0) for r in none)


def test_notices_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lower(text) rlike 'licen|reserved|cc'")
    labels = {label for g, _ in compared(docs) for label in g[6].split(",")}
    assert {"mit", "apache-2.0", "gpl-3.0", "gpl", "cc-by", "cc-by-nc", "reserved"} <= labels
