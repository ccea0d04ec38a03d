import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, words string, block long, bucket int, spans string, node long, n long, place int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "s", "ing"]) for _ in range(n))


def edge_rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, near copies, ties, repeated rows and clashing columns."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 140)) for _ in range(24)]
    texts = [*base, base[0], base[0].upper(), base[1].replace("alpha", "omega", 1), None, "", " \t\n", "one", "one", "a b c", "\x1c odd\u00a0space \x85 x"]
    passage = prose(rng, 30)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 9)}" for _ in range(5)]
    texts += [prose(rng, 6000), "x" * 50_000, "word " * 3000, "7" * 20_000, "line\nline\nother\nline\n" * 30]
    texts += ["0" * 5000 + ".1.1.1 and " + "9" * 5000 + ".1.1.1", f"{base[4]} {passage}"]
    rows = []
    for i, t in enumerate(texts):
        lang = [None, "en", "de"][i % 3]
        source = [None, "b", "a", "a", "a"][i % 5]
        n = None if t is None else len(t)
        rows.append((i, t, lang, source, n, 1, "w", 2, 3, "s", 4, 5, 6))
    rows.append(rows[5])  # a repeated row
    rows.append((None, base[2], None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
