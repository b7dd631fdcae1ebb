"""The registered raster queries against DuckDB over the smallest tables."""

import duckdb
import pytest

from rasterloom import catalog

SF = "/root/testdata/sf0.001"
#: Those whose SQL takes long in DuckDB are compared at sf0.01 only, outside of the tests.
SLOW = {"diagnose_large"}
NAMES = sorted(catalog.oracle_sql().keys() - SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    sql = con.sql(catalog.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    place = [sql.columns.index(c) for c in columns]
    assert got == sorted(str([r[i] for i in place]) for r in sql.fetchall())


def test_every_query_has_sql():
    assert catalog.queries().keys() - catalog.oracle_sql().keys() == {"enhance_pure_dsp", "enhance_hybrid", "enhance_tuned", "neural_fallback"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
