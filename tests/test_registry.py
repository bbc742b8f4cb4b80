"""Every registered query against its SQL."""

from collections import Counter

import duckdb
import pytest

from dumploom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(value):
    return round(value, 3) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    rows, sql = got.collect(), registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    order = [want.columns.index(c) for c in got.columns]
    assert len(order) == len(want.columns)
    assert Counter(tuple(map(rounded, r)) for r in rows) == Counter(tuple(rounded(r[i]) for i in order) for r in want.fetchall())
