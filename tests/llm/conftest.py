import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, least long, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long, repeated and tied rows, with extra columns of clashing names."""
    long_text = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "One Two"), (5, "one two"), (5, "one two"), (6, long_text), (7, long_text + " end"), (None, "null id"), (8, "ÀB à"), (9, "Àb à")]
    rows = [(i, t, None, "s", None, 1, 2, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter(F.lit(False))


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")
