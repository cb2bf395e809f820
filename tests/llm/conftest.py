import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hash long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    syllables = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split()
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]


@pytest.fixture(scope="session")
def sentence(words):
    def make(seed, n=9):
        rng = random.Random(seed)
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    return make


@pytest.fixture(scope="session")
def prose(sentence):
    def make(seed, sentences=20):
        text = [sentence(f"{seed}-{k}", 7 + k % 5) for k in range(sentences)]
        return "".join(s + ("\n" if k % 4 == 3 else " ") for k, s in enumerate(text)).strip()

    return make


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with two columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, "k", 1) for i, t, s in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs, prose):
    """Nulls in every column, empty and white texts, ties, repeated rows, one very long text."""
    long = " ".join(prose(f"long{k}", 60) for k in range(60))
    return make_docs(
        [
            (1, prose(1), "a"), (1, prose(1), "a"), (1, prose(2), "b"), (None, prose(3), "a"), (None, None, None),
            (2, None, "a"), (3, "", "b"), (4, " \t\n", None), (5, "one", "a"), (6, long, "a"), (7, "x" * 50_000, "b"),
            (8, "naïve café 東京 🙂 ß", None),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
