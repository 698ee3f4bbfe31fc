import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postweave.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 8)


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column over literal inputs: one(expression of col 'x', [inputs]) gives the outputs in order."""
    from pyspark.sql import functions as F

    def run(expression, inputs, kind="string"):
        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
