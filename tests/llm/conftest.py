import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{k % 977} of the and to in{k % 13}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [
        (1, "the cat and the dog are in the house. " * 20, "en", "a", 5),
        (1, "the cat and the dog are in the house. " * 20, "en", "a", 5),
        (2, "the cat and the dog are in the house. " * 20, "en", "a", 5),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (None, "no id here, but a text that is long enough to be read by all of them.", "de", "b", 9),
        (None, None, None, None, None),
        (5, LONG, "en", "b", 7),
        (6, " \t\n\x0b\x0c\r ", "fr", None, 3),
        (7, "é ß 日本語   x y \U0001f600", "fr", "c", 4),
        (8, "...", "", "c", 4),
    ]
    extra = ", key long, fp long, row string, hash long, record string, bucket int, place long, shard int, spans string, version long, run int, size long, id long, start long, run_ int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", 4, 5, 6, "z", 7, 8, 9, 10, 11, 12) for r in rows], DOCS + extra)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
