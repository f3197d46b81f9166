import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) with an extra column whose name an operator uses inside."""

    def make(rows, schema="doc_id bigint, text string, source string"):
        return spark.createDataFrame([(i, t, f"s{n % 3}") for n, (i, t) in enumerate(rows)], schema)

    return make
