import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) of the small table, on the driver."""
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with names used inside operators."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 7),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 7),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "x", 1),
        (4, " \t\n", "en", "b", 3, "x", 1),
        (5, "one", "de", "b", 3, "x", 1),
        (None, "alpha beta gamma delta epsilon eta", "en", "a", 1, "x", 7),
        (6, "wort und noch ein wort " * 4000, "de", "c", 1, "x", 7),
        (7, "???!!! 123", "en", None, 1, "x", 7),
    ]
    return spark.createDataFrame(rows, DOC + ", size string, shard long").withColumnRenamed("shard", "_row2")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC)
