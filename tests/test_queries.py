"""Every query against its SQL equivalent on the small tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {p.stem} as select * from '{p}'")
    return connection


def plain(rows, order):
    fix = lambda x: x.normalize() if isinstance(x, Decimal) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    found = registry.QUERIES[name](spark, SF)
    expected = db.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    names = sorted(found.columns)
    a = plain(found.collect(), [found.columns.index(n) for n in names])
    b = plain(expected.fetchall(), [expected.columns.index(n) for n in names])
    assert a == b and (a or name == "eval_case_mismatch")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
