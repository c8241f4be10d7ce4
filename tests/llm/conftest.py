import pytest

LONG = " ".join(f"word{i} the of thing{i % 97}" for i in range(12_000))
PASSAGE = " ".join(f"shared{i}" for i in range(80))
#: Null and empty texts, null ids, repeated rows, equal texts, a very long text, odd characters.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and " + PASSAGE),
    (2, None), (3, ""), (4, LONG), (5, "the quick brown fox jumps over the lazy dog and " + PASSAGE),
    (6, "other words come first " + PASSAGE + " and others last"), (6, "other words come first " + PASSAGE + " and others last"),
    (None, "a text without an id " + PASSAGE), (7, "é 漢字 😀 \u0000 mixed \t\n white  space"), (8, "one"), (9, "Released under the MIT License."), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names clash with what operators use inside."""
    rows = [(i, t, "c", 1, 2, "b", "w", 3.0, "n", "l") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, bucket int, block int, band string, words string, score double, next string, node string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
