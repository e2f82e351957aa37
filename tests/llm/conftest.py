import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, source) rows; a source may be left out."""

    def make(*rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            full = [r + (f"x{i}",) for i, r in enumerate(full)]
        return spark.createDataFrame([Row(*r) for r in full], SCHEMA + (f", {extra} string" if extra else "")).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
