import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "benchmark")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
