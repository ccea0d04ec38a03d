"""Near duplicates and repeated windows against brute force."""

import hashlib
import re

import numpy as np

from tidemark.llm import neardup, substring
from tidemark.sources import checkpoints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_groups(rows, width):
    sets = []
    for r in rows:
        w = WORD.findall(lower(r.text))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                group[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    return sorted((r.doc_id is None, r.doc_id or 0, len(sets[i]), least.get(top(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows))


def found_groups(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect())


def test_near_duplicates_edge_cases(edge_docs, no_docs):
    for width in (4, 5):
        got = neardup.near_duplicates(edge_docs, width)
        assert found_groups(got) == slow_groups(edge_docs.collect(), width)
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got.collect())
    assert neardup.near_duplicates(no_docs).count() == 0


def test_chains_and_large_groups(spark):
    """Variants that are similar to few others each, so that pivots alone do not link them."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for j in range(7):
            words[(i * 3 + j * 29) % 200] = f"v{i}x{j}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(500 + k, " ".join(chain[k * 8 : k * 8 + 120])) for k in range(20)]  # each like its neighbours only
    rows += [(700 + k, " ".join([*(f"p{i}" for i in range(60)), *(f"own{k}x{i}" for i in range(50))])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(neardup.near_duplicates(docs, 4)) == slow_groups(docs.collect(), 4)
    assert found_groups(neardup.near_duplicates(docs, 4, rounds=1)) == slow_groups(docs.collect(), 4)


def test_links_run_through_rows_without_an_id(spark):
    words = [f"n{i}" for i in range(300)]
    middle = words[:6] + ["m1"] + words[7:]
    rows = [(1, " ".join(words[:290])), (None, " ".join(words[12:])), (2, " ".join(words[26:] + ["z1", "z2", "z3"])), (2, " ".join(middle[150:])), (None, "alone " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(neardup.near_duplicates(docs, 4)) == slow_groups(docs.collect(), 4)


def test_shared_counts_in_slices():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, n)) for n in (0, 3, 150, 390, 80)]
    got = neardup.shared_counts(sets[:3], sets, width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


def test_keep_one_returns_documents(edge_docs):
    kept = neardup.keep_one(edge_docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def slow_kept(rows, width=5):
    """Rows of smallest doc_id (null last) of each group; rows of a tie may be any of it."""
    sets, group = [], list(range(len(rows)))
    for r in rows:
        w = WORD.findall(lower(r.text))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                group[top(i)] = top(j)
    found = {}
    for i, r in enumerate(rows):
        found.setdefault(top(i), []).append((r.doc_id is None, r.doc_id or 0, r))
    return [[x[2] for x in g if x[:2] == min(y[:2] for y in g)] for g in found.values()]


def check_kept(docs):
    groups = slow_kept(docs.collect())
    left = neardup.keep_one(docs).collect()
    assert len(left) == len(groups)
    for g in groups:
        left.remove(next(r for r in left if r in g))


def test_keep_one_by_brute_force(spark, edge_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    check_kept(edge_docs.select(columns))
    check_kept(edge_docs.select(columns).where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert neardup.keep_one(no_docs).count() == 0
    text = [" ".join(f"{p}{i}" for i in range(60)) for p in "abcdef"]
    near = lambda t: t + " end"
    rows = [
        (None, text[0]), (None, near(text[1])), (3, text[1]), (None, text[2]), (None, near(text[2])),  # null ids
        (7, text[3]), (7, text[4]), (7, near(text[4])), (8, text[5]), (6, near(text[5])), (6, text[0] + " x y z q r"), (9, ""), (None, None),  # repeated ids
    ]
    check_kept(spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))


def slow_removal(rows, window=13):
    words = [WORD.findall(r.text or "") for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if r.doc_id is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if r.doc_id is not None and first[tuple(w[i : i + window])] < r.doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r.doc_id is None, r.doc_id or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeated_windows(edge_docs, no_docs, monkeypatch):
    want = slow_removal(edge_docs.collect())
    for batch in (1_000_000, 200):  # all in one task's batch, and spread over many
        monkeypatch.setattr(substring, "BATCH", batch)
        got = substring.remove_repeats(edge_docs, bucket_size=500).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring.remove_repeats(no_docs).count() == 0


def test_texts_that_share_an_id_lose_only_their_own_words(spark, monkeypatch):
    w, x, y = ([f"{p}{i}" for i in range(40)] for p in "wxy")
    rows = [(1, w), (2, w[:20]), (2, y), (2, [*y[:15], *x[:20]]), (3, x), (3, [*x[5:30], *y[2:30]]), (3, x), (1, y[20:])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    want = slow_removal(docs.collect())
    assert [r[3] for r in want if r[1] == 2] == [20, 20, 0] or sorted(r[3] for r in want if r[1] == 2) == [0, 20, 20]
    for batch in (1_000_000, 30):
        monkeypatch.setattr(substring, "BATCH", batch)
        got = substring.remove_repeats(docs, bucket_size=50).collect()
        assert sorted((False, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_durable_ends_with_its_last_task(spark, tmp_path):
    """A join with an empty side doesn't end before the tasks of its other side, whose shuffles go with the query."""
    marks = str(tmp_path)

    def slow(batches):
        import os
        import time
        import uuid

        time.sleep(3)
        open(os.path.join(marks, uuid.uuid4().hex), "w").close()
        yield from batches

    none = spark.range(0, 100, 1, 2).where("id < 0")
    some = spark.range(0, 100, 1, 2).repartition(2, "id").mapInArrow(slow, "id long")
    rules = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(rules, None)
    assert checkpoints.durable(none.join(some.hint("merge"), "id")).count() == 0
    assert len(list(tmp_path.iterdir())) == 2
    assert spark.conf.get(rules, None) == before
