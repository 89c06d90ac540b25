"""Every query that SQL expresses, against DuckDB on the same tables."""

import decimal
import os

import duckdb
import pytest

from newsloom.plans import registry
from newsloom.sources.tables import NAMES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert columns == sorted(names)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"post_relations", "evidence_clusters"}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
