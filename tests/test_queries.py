"""Every query of the reference layer that has SQL, side by side with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from saunter.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLES.keys() and plans.ORACLES.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_place_on_the_edge_is_zero_on_both_sides(spark, tmp_path):
    """A hundred steps of 0.1 from z = 118 end just under 128: the place 0, in the query and in its SQL."""
    user = next(u for u in range(128) if u * 71 % 128 == 118)
    steps = spark.range(100).selectExpr("id * 180 AS event_id", "timestamp_seconds(id) AS ts", f"CAST({user} AS BIGINT) AS user_id", "1.0D AS value")
    steps.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = plans.QUERIES["wrapped_position"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert rows(got) == rows(con.sql(plans.ORACLES["wrapped_position"]).df())
    assert got.sort_values("step")["z"].iloc[-1] == 0.0 and got["z"].max() < 128
