import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeats, one very long text and word,
    and columns whose names operators use themselves."""
    words = " ".join(f"w{i % 977}" for i in range(60_000))
    line = " ".join(f"same{i}" for i in range(60))
    rows = [
        (1, line + " one tail", "en"), (2, "other head " + line, "en"), (2, "other head " + line, "en"), (None, line, None), (None, None, None),
        (3, None, "de"), (4, "", "fr"), (5, " \t\n ", "fr"), (6, words, "en"), (7, "x" * 200_000, "en"), (8, "a b", "es"), (8, "a different text", "es"),
        (9, "Ünï cödé ñandú 你好 😀 naïve — ok", "de"), (10, "<|endoftext|> middle <|endoftext|>", None),
    ]
    clash = [(*r, k, "x", 1.5, True, "bucket") for k, r in enumerate(rows)]
    return spark.createDataFrame(clash, "doc_id bigint, text string, lang string, n_words int, _row string, score double, kept boolean, hits string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
