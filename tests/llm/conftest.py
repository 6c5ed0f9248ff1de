import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents (doc_id, text) with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, score string, fp double")

    return make


@pytest.fixture(scope="session")
def sf():
    return SF
