from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, id_type="long"):
        names = f"doc_id {id_type}, text string, lang string, source string, row long, n long, id long, digest string, kept string"
        full = [(i, t, "en", "s", 1, 2, 3, "d", "k") for i, t in rows]
        return spark.createDataFrame(full, names)

    return make
