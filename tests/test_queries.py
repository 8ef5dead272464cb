"""Every registered query of the library against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

from archivelake import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if x is None else str(x) if isinstance(x, (str, bool)) else str(float(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, other, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    if name in queries.ORACLE_SQL:
        theirs = other.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in theirs.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[i] for i in order) for r in theirs.fetchall()])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
