"""Queries over made lineitems that the given tables are too small to hold, against their SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import plain


@pytest.fixture
def differ(spark, tmp_path):
    """Rows of a query and of its SQL over lineitems (symbol, week, quantity)."""

    def run(name, rows):
        start = datetime.datetime(1992, 1, 6)
        data = [(n, 1, symbol, 1, float(quantity), 100.0, 0.05, start + datetime.timedelta(7 * week)) for n, (symbol, week, quantity) in enumerate(rows)]
        spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        return plain(entry.queries()[name](spark, str(tmp_path)).toPandas()), plain(con.execute(entry.oracle_sql()[name]).fetchdf())

    return run


def test_distance_from_the_mean_without_a_range(differ):
    # Prices fall to the floor and stay there: first below their mean, at last equal to it, with an average range of zero.
    got, want = differ("trend_features", [(1, week, 1) for week in range(500)])
    assert got == want
    assert any("-inf" in row for row in got) and sum("" == row[1] for row in got) > 199
