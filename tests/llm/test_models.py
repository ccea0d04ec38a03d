"""Language, neighbours, mixing, packing, urls and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, language, mixing, packing, urls

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.op8_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found) / len(found)
    assert right > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in language.op8_language(spark, SF).collect())


def test_language_edge_cases(spark, edge_docs, no_docs):
    rows = language.identify(edge_docs, ["doc_id", "text"]).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.identify(no_docs, ["doc_id", "text"]).count() == 0
    untaught = edge_docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identify(untaught, ["doc_id", "text"]).collect()} == {"und"}
    assert language.grams("\U0001f600 \U00010400") is not None and language.grams("12 --") is None


def bound(gram):
    a, b, c = (language.letter(p).astype(int) for p in gram)
    return np.roll(a, 2) * np.roll(b, 1) * c


def slow_grams(text):
    """Three-letter grams around each letter, runs of other characters being one gap."""
    letters = [0]
    for ch in text or "":
        x = ord(ch.lower()[0]) if ch.isalpha() else 0
        if x or letters[-1]:
            letters.append(x)
    letters += [0]
    return [tuple(letters[i - 1 : i + 2]) for i in range(1, len(letters) - 1) if letters[i]]


def slow_bundle(text):
    return sum(bound(g) for g in slow_grams(text))


def test_language_by_bound_and_bundled_vectors(spark):
    """Predictions against explicit gram vectors, in one block of languages and in several; each script's letters count."""
    texts = {
        "en": ["the cat and the dog", "this is that thing there"], "de": ["der hund und die katze", "das ist ein ding dort"],
        "ru": ["кошка и собака", "это вещь там"], "uk": ["кішка і собака є", "це річ там її"], "el": ["η γάτα και ο σκύλος"], "zh": ["猫和狗在这里", "这是一个东西"],
    }
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    rows = [(next(j for j in range(100 * i, 100 * i + 100) if zlib.crc32(str(j).encode()) % 3 != 1), t, lang) for i, t, lang in rows]
    asked = [(90001, "the thing and that dog"), (90002, "собака там"), (90003, "річ її є"), (90004, "狗在这"), (90005, "σκύλος"), (90006, "hund dort"), (90007, "12 !"), (90008, "þ")]
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t in asked)], "doc_id long, text string, lang string")
    bundles = {}
    for lang, ts in texts.items():
        bundles[lang] = sum(slow_bundle(t) / len(slow_grams(t)) for t in ts) / len(ts)
    middle = sum(bundles.values()) / len(bundles)
    protos = {k: (v - middle) / np.linalg.norm(v - middle) for k, v in sorted(bundles.items())}
    for size in (1000, 2):
        got = {r.doc_id: r for r in language.identify(docs, ["doc_id", "text"], size).collect()}
        for i, t in asked:
            if not slow_grams(t):
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            counts = np.unique(np.array(slow_grams(t)), axis=0, return_counts=True)[1]
            c = {k: float(slow_bundle(t) @ p) / np.sqrt(language.DIMENSIONS * (counts**2).sum()) for k, p in protos.items()}
            assert got[i].lang_pred == max(c, key=c.get)
            odds = np.exp(20 * (np.array(list(c.values())) - max(c.values())))
            assert got[i].score == pytest.approx(1 / odds.sum(), rel=1e-4)
            assert np.linalg.norm(slow_bundle(t)) == pytest.approx(np.sqrt(language.DIMENSIONS * (counts**2).sum()), rel=0.2)
    want = {90001: "en", 90002: "ru", 90003: "uk", 90004: "zh", 90005: "el", 90006: "de"}
    assert {i: got[i].lang_pred for i in want} == want


def test_keep_identified_drops_only_texts_without_a_letter(edge_docs, no_docs):
    def lettered(docs):
        return sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect() if any(c.isalpha() for c in r.text or "")), key=repr)

    def found(docs):
        return sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in language.keep_identified(docs).collect()), key=repr)

    assert found(edge_docs) == lettered(edge_docs)
    given = {r.doc_id: r.lang for r in edge_docs.collect()}
    for r in language.keep_identified(edge_docs).collect():
        assert r.lang == given[r.doc_id] if given[r.doc_id] else r.lang in ("en", "de")
    assert language.keep_identified(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert found(unlabelled) == lettered(unlabelled)
    assert {r.lang for r in language.keep_identified(unlabelled).collect()} == {None}
    for docs in (edge_docs.where(language.held_out()), edge_docs.withColumn("lang", F.lit("und"))):
        assert found(docs) == lettered(docs) != []


def brute_neighbours(rows, queries, k):
    out = {}
    for q, v in queries:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
        out[q] = [i for _, i in s]
    return out


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    vectors += [(100 + i, vectors[3][1]) for i in range(5)]  # ties
    odd = [(200, None), (201, [0.0] * 8), (202, [1.0] * 7 + [None]), (203, [1.0] * 7 + [float("nan")]), (204, [1.0] * 7 + [float("inf")]), (205, [1.0])]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in vectors + odd], "vec_id long, embedding array<double>, rank int, score double")
    found = ann.nearest(df, df.where("vec_id % 20 = 0"), 5, trees=24, block_rows=16, block_queries=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(vectors, [x for x in vectors if x[0] % 20 == 0], 5)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0), 5).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).collect()
    assert {r.vec_id for r in few} == {1, 2}


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, sf_dir):
    """All queries against brute force."""
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    place = {i: n for n, i in enumerate(ids.tolist())}
    found = {}
    for r in ann.op2_ann(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[place[r.query_id]] @ x[place[r.vec_id]]), abs=1e-12)
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = []
    for q, got in found.items():
        s = x @ x[place[q]]
        s[ids == q] = -9
        hits.append(len(got & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_forest_gathers_what_an_ascent_does():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 6))
    planes = ann.directions(7, 5, 1)
    h, q = ann.row_strings(x, 10.0, planes, 5), ann.query_strings(x[:40], planes, 5)
    forest = ann.Forest(h)
    same = np.array([[[32 - int(a ^ b).bit_length() for a, b in zip(r, s, strict=True)] for r in h] for s in q])
    for wanted in (1, 20, 300, 2500, 9999):
        length, _, _ = forest.descend(q, wanted)
        want = [next((n for n in range(32, -1, -1) if (m >= n).sum() >= wanted), 0) for m in same]
        assert length.tolist() == want
        got = [f.tolist() for f in forest.candidates(q, wanted)]
        assert got == [np.flatnonzero((m >= n).any(axis=1)).tolist() for m, n in zip(same, want, strict=True)]


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.1]), (2, [0.5, 0.5]), (3, [0.1, 1.0]), (3, [0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 3"), 3).collect())
    assert [f[2] for f in found] == [2, 1, 2] or len(found) == 3
    assert all(f[2] != 3 for f in found)


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 2 * sizes[n]}
        if not over:
            return target | share
        for n in over:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
        free -= over
    return target


def test_mixing(edge_docs, no_docs):
    rows = mixing.mix(edge_docs, block_words=300, keep=("doc_id",)).collect()
    assert len(rows) == edge_docs.count()
    source = {}
    for r in edge_docs.collect():
        size = len((r.text or "").translate({c: 32 for c in range(9, 14)}).replace("\x1c", "c").replace("\x85", "c").replace("\u00a0", "c").split(" "))
        size = sum(1 for w in (r.text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w)
        source[r.source] = source.get(r.source, 0) + size
    want = slow_targets(source)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert sum(d.words for d in r.draws) == r.taken
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sorted(s for s, _ in by) == sorted(source.values())
    for (size, target), taken in by.items():
        assert any(target == pytest.approx(want[s]) for s in want if source[s] == size)
        assert abs(sum(taken) - target) <= 1
    again = mixing.mix(edge_docs.repartition(5), block_words=300).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken, str(r.draws))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(no_docs).count() == 0


def test_splitting_tree_is_exact():
    quotas = np.array([50, 0, 7, 993])
    leaves = list(mixing.dealt(quotas, 13, 0, 13, 5))
    assert sum(q for _, _, q in leaves).tolist() == quotas.tolist()
    assert {int(q.sum()) for _, _, q in leaves} <= {1050 // 13, 1050 // 13 + 1}
    for place in range(4):
        seen = [n for _, a, q in leaves for n in range(a[place], a[place] + q[place])]
        assert sorted(seen) == list(range(quotas[place]))
    alone = [x for i in range(13) for x in mixing.dealt(quotas, 13, i, i + 1, 5)]
    assert all((a[2] == b[2]).all() and (a[1] == b[1]).all() for a, b in zip(leaves, alone, strict=True))


def test_mixing_agrees_in_reruns_where_rows_share_an_id(spark):
    rows = [(1, f"{'word ' * 9}text{i}", "en", "ab"[i % 2], 1) for i in range(36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [
        sorted((r.text, r.size, r.taken) for r in mixing.mix(d, block_words=100, total_share=1.37, keep=("doc_id", "text")).collect())
        for d in (docs, docs.repartition(7), docs.orderBy(F.desc("text")).repartition(3))
    ]
    assert runs[0] == runs[1] == runs[2] and len({t for *_, t in runs[0]}) > 2


def test_mixed_documents(edge_docs):
    mixed = mixing.mixed_documents(edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"]), block_words=300)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    plan = mixing.mix(edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"]), block_words=300).collect()
    words = lambda t: sum(1 for w in t.translate({c: 32 for c in range(9, 14)}).split(" ") if w)
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    assert got == {r.doc_id: r.taken for r in plan if r.taken}


def test_mixed_documents_with_repeated_and_missing_ids(spark, edge_docs):
    """Every row's words are those its plan takes, also where rows share an id, a text or both, or have no id."""
    words = lambda t: sum(1 for w in (t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w)
    texts = ["one two three", "four five", "six"]
    rows = [(None, t, "en", s, len(t)) for t in texts for s in ("a", "b", None)] + [(4, texts[0], "en", "a", 1)] * 2 + [(4, texts[1], "en", "a", 1), (5, None, None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(edge_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    mixed = mixing.mixed_documents(docs, block_words=50)
    plan = mixing.mix(docs, block_words=50, keep=("doc_id",)).collect()
    want, got = {}, {}
    for r in plan:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def check_packing(df, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for t in texts]
    want = sorted((zlib.crc32(x.tobytes()), len(x)) for x in ids)
    rows = df.collect()
    total = sum(r.length for r in rows)
    assert total == sum(map(len, ids))
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return rows, ids, want, padding / max(total, 1)


def test_packing_round_trip(edge_docs, no_docs):
    docs = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    source = docs.collect()
    rows, ids, _, padding = check_packing(packing.pack_documents(docs), [r.text for r in source])
    by_id = {r.doc_id: x for r, x in zip(source, ids, strict=True)}
    for r in rows:
        x = by_id[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    assert padding <= 0.02
    assert packing.pack_documents(no_docs).count() == 0
    assert packing.pack_documents(edge_docs).selectExpr("sum(length)").first()[0] > sum(map(len, ids))


def test_packing_many_buffers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, ids, want, padding = check_packing(packing.pack_documents(docs, buffer_tokens=20_000), [r.text for r in docs.collect()])
    assert padding <= 0.02
    by_id = dict(zip((r.doc_id for r in docs.collect()), ids, strict=True))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    whole = []
    for doc_id, spans in pieces.items():  # a document's pieces tile it, without gap or overlap
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        whole.append((zlib.crc32(by_id[doc_id].tobytes()), at))
    assert sorted(whole) == want


def test_tokens_of_odd_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), packing.WordTokens(path)
    for text in ("It's <|endoftext|> A<|ENDOFTEXT|>b. x.,| e\u0301 \u0130stanbul \x1c a\u00a0b ΣΑΣ. 123abc! 's", "", "...", "A.B.C., d"):
        assert own.encode(text.encode()).tolist() == model.encode(text, add_special_tokens=False).ids


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((6, 15)), rng.random(6)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-5 and abs(gain[x > 0]).max(initial=0) < 1e-5


def test_url_cascade_is_exact(spark):
    keys = [(f"host{i}.net", i % 7 == 0) for i in range(3000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    levels = urls.build_cascade(universe)
    wrong = universe.where(urls.listed(F.col("key"), levels) != F.col("listed")).count()
    assert len(levels) > 1 and wrong == 0
    assert urls.build_cascade(universe.where("not listed")) == []
    rows = universe.select("key").unionByName(universe.select("key")).withColumn("shard", F.lit("x"))
    for max_bits in (1 << 24, 1000):  # one cascade, and five shards
        got = urls.with_membership(rows.drop("shard"), universe.where("listed").select("key"), max_bits)
        assert sorted((r.key, r.listed) for r in got.collect()) == sorted(2 * keys)


def test_shards_hold_what_the_first_level_wrongly_finds(spark):
    """A small list in a large universe: no level of any shard is larger than the bound allows for."""
    assert urls.shards_for(3000, 3_000_000, 1 << 24) == 1 and urls.shards_for(3000, 3_000_000, 1 << 16) == 10
    assert urls.shards_for(10**8, 10**10, 1 << 24) == 120 and urls.shards_for(0, 0, 64) == 1
    keys = spark.range(200_000).selectExpr("concat('host', id, '.net/') key", "id % 10000 = 0 listed")
    max_bits = 1 << 12
    shards = urls.shards_for(20, 199_980, max_bits)
    one = keys.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)) == 0)
    assert shards == 10 and max(level.bits for level in urls.build_cascade(one)) <= 2 * max_bits
    got = urls.with_membership(keys.select("key"), keys.where("listed").select("key"), max_bits)
    assert got.where("listed").count() == 20


def test_url_cascade_on_pages_equals_a_join(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    list_ = urls.listed_by_hash(pages)
    universe = urls.key_universe(urls.parsed(pages), list_).checkpoint()
    levels = urls.build_cascade(universe)
    assert len(levels) >= 2 and universe.where(urls.listed(F.col("key"), levels) != F.col("listed")).count() == 0
    rows = urls.parsed(pages)
    joined = rows.join(list_.withColumn("l", F.lit(True)), "key", "left").select("page_id", F.coalesce("l", F.lit(False)).alias("listed"))
    got = urls.with_membership(rows, list_, max_bits=3000).select("page_id", "listed")
    assert got.exceptAll(joined).isEmpty() and joined.exceptAll(got).isEmpty() and got.where("listed").count() > 50


def test_url_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "http://ORG/x"), (5, "https://a.Example.ORG/en/12?q"), (6, "x://spam.net#f"), (7, "http://b.com/fr/"), (8, "http://bcom/fr/"), (9, "http://example.org"), (9, "http://example.org"), (10, "a://b://c.com/de/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    list_ = spark.createDataFrame([(None,), ("elsewhere.net/",), ("spam.net",), ("spam.net",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(pages, list_).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("org", "/x", "org/", "allow"), 5: ("a.example.org", "/en/12", "example.org/en/1", "block"), 6: ("spam.net", "", None, "block"),
        7: ("b.com", "/fr/", "com/fr/", "allow"), 8: ("bcom", "/fr/", None, "allow"), 9: ("example.org", "", None, "allow"),
        10: ("b:", "//c.com/de/", None, "allow"),
    }
    assert {r.verdict for r in urls.url_filter(pages.where("page_id = 6"), list_.limit(0)).collect()} == {"allow"}
    assert urls.url_filter(pages.limit(0), list_.limit(0)).count() == urls.url_filter(pages.limit(0), list_).count() == 0


def test_url_sql(spark):
    import oracle

    con = oracle.connect(SF)
    assert oracle.mismatch(urls.op9_urls(spark, SF), urls.OP9_SQL, con) is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF).checkpoint()
        assert sorted(kept.columns) == sorted(columns)
        if name in ("language", "neardup"):
            assert kept.count() <= before
        if name == "pii":
            assert kept.count() == before and kept.where("text like '%@mail%'").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and packed.where("offset + length > 4096").count() == 0


def test_stages_on_nulls_repeats_and_clashing_columns(spark, edge_docs, no_docs):
    """Each stage on all that the one before kept: columns of documents, nothing clean lost, and no rows from no rows."""
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, empty = edge_docs, no_docs
    before = edge_docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, SF).checkpoint(), stage(spark, empty, SF).checkpoint()
        assert empty.count() == 0
        if name == "packing":
            break
        assert docs.columns == names
        n = docs.count()
        if name == "language":
            assert n == sum(any(c.isalpha() for c in r.text or "") for r in edge_docs.collect())
        elif name == "neardup":
            assert 0 < n < before
        elif name == "pii":
            assert n == before
        before = n
    assert docs.where("offset + length > 4096").count() == 0
    assert docs.count() >= docs.select("sequence_id").distinct().count() > 0


def test_pipeline_mixes_by_identified_language(spark):
    """What the language stage finds decides the pools that the mix draws from, whatever the labels were."""
    import corpus_pipeline

    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    english, german = "the thing and that dog with this house", "der hund und das haus mit einem ding dort"
    rows = [(ids[i], f"{english} {i}", "en", "a", 1) for i in range(60)] + [(ids[100 + i], f"{german} {i}", "de", "a", 1) for i in range(12)]
    given = spark.createDataFrame([*rows, (5000, f"{german} alone", "en", "a", 1), (5001, f"{german} else", None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language"](spark, given, SF).checkpoint()
    assert {r.doc_id: r.lang for r in found.collect()} == {r[0]: r[2] for r in rows} | {5000: "de", 5001: "de"}

    def taken(docs):
        return {r.doc_id: r["count"] for r in stages["mixing"](spark, docs, SF).groupBy("doc_id").count().collect()}

    scarce = {r[0] for r in rows if r[2] == "de"} | {5000, 5001}
    mixed = taken(found)
    assert all(mixed[i] == 2 for i in scarce)  # a pool of its own, up to the most repeats
    plain = mixing.mixed_documents(given).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in plain} != mixed != taken(given)
    sizes = {}
    for r in mixing.mix(found.withColumn("its", F.col("lang")), by_language=True, keep=("doc_id", "its")).collect():
        sizes.setdefault(r.its, []).append((r.size, r.source_size, r.target, r.taken))
    for pool in sizes.values():
        assert {x[1] for x in pool} == {sum(x[0] for x in pool)}
        assert abs(sum(x[3] for x in pool) - pool[0][2]) <= 1
    assert sum(p[0][2] for p in sizes.values()) == pytest.approx(1.5 * sum(p[0][1] for p in sizes.values()))
