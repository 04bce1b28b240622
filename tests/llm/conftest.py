import pytest


@pytest.fixture
def table(spark):
    """Documents with an extra column whose name clashes with those the operators make."""

    def make(rows):
        return spark.createDataFrame([(d, t, "x", 1, "n") for d, t in rows], "doc_id long, text string, keep_id string, n_tokens int, _words string")

    return make
