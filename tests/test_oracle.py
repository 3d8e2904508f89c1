"""Every registered query against its DuckDB oracle over the sf0.001 fixture."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from grantlens.plans import registry
from tools.oracle_check import TABLES, rows

from .conftest import SF_SMALL

ORACLES = registry.oracle_sql()
NAMES = registry.names()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(ORACLES)
    assert set(NAMES) <= set(E.queries()) and ORACLES.items() <= E.oracle_sql().items()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["issue_id", "issue_type", "request_id", "principal_email", "resource_name", "role",
                          "detected_at", "severity", "status", "details"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    odf = con.sql(ORACLES[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert rows(sdf) == rows(odf)
