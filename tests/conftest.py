import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from placerank.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__sql__autoBroadcastJoinThreshold="10485760",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def column_of(spark):
    """Evaluate a Column function over a list of values, in order."""

    from pyspark.sql import functions as F

    def run(values, fn, schema="x string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, " + schema)
        return [r[0] for r in df.orderBy("i").select(fn(F).alias("out")).collect()]

    return run
