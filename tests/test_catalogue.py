"""Every query of the engine against DuckDB on the small tables."""

import os

import duckdb
import pytest

from keyloom.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(values, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at]) for r in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    found = rows([tuple(r) for r in got.collect()], got.columns, sorted(got.columns))
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert found == rows(want.fetchall(), want.columns, sorted(got.columns))
    else:
        assert found
