"""Queries of the training-data operators against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillframe.llm import parts


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", parts.ORACLE)
def test_query(spark, duck, sf, name):
    found = parts.QUERIES[name](spark, sf)
    told = duck.execute(parts.ORACLE[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(found.columns)
    expected = sorted(tuple(map(plain, r)) for r in told.fetchall())
    assert sorted(tuple(map(plain, r)) for r in found.select(*names).collect()) == expected
