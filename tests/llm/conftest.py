import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, fp string, row_key int"


@pytest.fixture(scope="session")
def spark():
    from chronotile.session import local_session

    return local_session("*", 8)


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = "word mail a.b@c.org " * 3000 + "x" * 20000
    rows = [
        (1, "one two three four five six", "en", "s1", 1, 7, 0.5, "f", 1),
        (1, "one two three four five six", "en", "s1", 1, 7, 0.5, "f", 1),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "s2", 0, 0, 0.0, "", 0),
        (None, "ein kurzer Text mit ▁ und \t Zeichen 😀  ", "de", None, 5, 1, 1.0, "g", 2),
        (5, long_text, "en", "s1", 5, 1, 1.0, "g", 2),
        (6, "ONE two three four five six", "en", "s2", 5, 1, 1.0, "g", 2),
    ]
    return spark.createDataFrame(rows, DOCS)
