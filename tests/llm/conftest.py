import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "Same text here with seven words inside"), (5, "Same text here with seven words inside"), (5, "Same text here with seven words inside"),
        (None, "a row without an id that has words"), (6, long), (7, "x" * 70000), (8, "ünï çödé ñ 中文 \U0001f600 tail"), (9, "same  TEXT here with seven words inside"), (10, "<|endoftext|> inside <|endoftext|>"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("fp", "e", "g", "row", "key", "r1", "h1", "score", "length", "piece", "digest", "n_chars", "label", "word", "w")}).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
