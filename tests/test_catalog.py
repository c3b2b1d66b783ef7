"""Every query of the catalog equals its SQL on the smallest tables."""

import duckdb
import pytest

from meterline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == want


def test_entry_imports_without_the_operators_on_texts():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
