import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.", "en"),
    (2, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "12 345 !!", None),
    (6, "word " * 60_000, "en"),
    (7, "x" * 300_000, "en"),
    (8, "日本語のテキスト です。 ÄÖÜ straße", "de"),
    (8, "日本語のテキスト です。 ÄÖÜ straße", "de"),
    (None, "a row without an id, but with enough words in it", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, extra columns with names that operators use."""
    rows = [(i, t, l, "s", 1, "k", "x", 0.5) for i, t, l in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, words string, score double")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 0, 0), (4, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id bigint, quality int, toxic int")


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()
