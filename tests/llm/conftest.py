import pytest

#: Nulls, empty and blank texts, repeated rows, a shared id, a long text, copies, and columns with clashing names.
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (3, None, "en", "b", None), (4, "", None, None, 0), (5, "   \t\n ", "en", "b", 6), (None, "a text without an id", "en", "a", 20),
    (None, "another text without an id", "en", None, 26), (6, "one", "en", "c", 3), (7, "two words", "en", "c", 9), (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (8, LONG, "en", "a", len(LONG)), (9, "Été À l'école 😀 naïve", "fr", "d", 21), (10, LONG + " end", "en", "a", len(LONG) + 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "fp long, key long, size long, blob string, score double, y int, n int, taken long, node long"


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with extra columns whose names operators use inside."""
    rows = [(*r, 1, 2, 3, "b", 0.5, 1, 2, 3, 4) for r in ROWS]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
