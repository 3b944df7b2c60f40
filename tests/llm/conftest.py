import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, h string, n_words int, places string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those the operators add."""
    long = " ".join(f"w{i % 4000}x" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "   \n \t", "de", None),
        (5, long, "en", "a"), (5, long, "en", "a"), (6, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "b"),
        (None, "no id but words to read here", "fr", "b"), (None, None, None, None), (7, "one", "en", "a"), (8, "one", "en", "a"),
        (9, "Ünïcödé wörds ß 𝒳𝒴 und so weiter\nzweite Zeile mit Text darin", "de", "b"), (9, "another text of the same id\nzweite Zeile mit Text darin", "de", "b"),
        (2**60 + 1, "a far id has its own text", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 7, 0.5, 3, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
