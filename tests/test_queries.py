"""Every registered query outside the corpus operators against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from terrafold.jobs import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sql():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{f'{path}/*.parquet' if path.is_dir() else path}'")
    return connection


def in_order(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].sort_values(columns).reset_index(drop=True)


def test_each_sql_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got, expected = in_order(registry.QUERIES[name](spark, SF_DIR).toPandas()), in_order(sql.execute(registry.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, atol=1e-6)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0
