import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """docs([(id, text), ...]) as a table with an extra column whose name clashes with the operators' own."""
    def make(rows, key="doc_id"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"{key} long, text string, label string")
    return make
