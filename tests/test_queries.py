"""Every catalogue query against DuckDB on the smallest tables, and a check that a wrong answer is noticed."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from framesift.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    plain = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    return sorted(repr([plain(x) for x in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.oracle_sql():
        wanted = duck.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert rows(got) == rows(wanted)


def test_red(spark, duck):
    """A changed constant must show."""
    sql = catalogue.oracle_sql()["fixed_predictor_cost"]
    sql = sql.replace("THEN 2 * (e)", "THEN 3 * (e)")
    assert rows(catalogue.queries()["fixed_predictor_cost"](spark, SF).toPandas()) != rows(duck.sql(sql).df())


def test_every_query_but_a_few_has_an_oracle():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"crc32_payload", "checksums", "cluster_cuts", "bit_reservoir", "tile_groups"}
