"""Every registered query vs its DuckDB oracle on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as E
from tabloom.plans import registry
from tools.oracle_check import compare, duck

from conftest import SF_SMALL

QUERIES = registry.queries()
SQL = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - set(SQL)) == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    msg = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert " OK " in msg, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"query_id", "source", "page", "rank", "score"}
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_types_match_oracle(spark, con, name):
    sp = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, SF_SMALL).schema.fields}
    dk = {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in sp.items()} == dk
