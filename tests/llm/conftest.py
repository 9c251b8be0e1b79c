import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, schema=SCHEMA, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def con():
    """DuckDB over the smallest test tables, if they are there."""
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c, folder
