"""Every catalogue query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the generated tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in found))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, duck, name):
    result = catalogue.QUERIES[name](spark, str(DATA))
    wanted = duck.sql(catalogue.ORACLE[name])
    assert rows(result.columns, result.collect()) == rows(wanted.columns, wanted.fetchall())


def test_names():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert all(catalogue.QUERIES[x].__doc__ for x in catalogue.QUERIES)
