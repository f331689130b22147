"""Every registered core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillframe.plans import facts  # noqa: F401  registers its queries
from quillframe.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    told = duck.execute(ORACLE[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(found.columns)
    expected = sorted(tuple(map(plain, r)) for r in told.fetchall())
    assert sorted(tuple(map(plain, r)) for r in found.select(*(f"`{n}`" for n in names)).collect()) == expected
