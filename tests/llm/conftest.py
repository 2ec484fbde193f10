import tempfile

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def tables(spark):
    """Write small tables to a fresh folder and return it."""

    def write(**given):
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write


@pytest.fixture()
def documents(tables):
    """A folder with documents of (id, text) or (id, text, lang, source)."""

    def write(rows, **others):
        full = [(*r, *("en", "s")[len(r) - 2 :], 0) if len(r) < 5 else r for r in rows]
        return tables(documents=(full, DOCS), **others)

    return write
