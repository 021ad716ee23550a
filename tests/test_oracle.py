"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    from check import duck as connect
    return connect(SF)


def _names():
    from geotables.plans.catalog import QUERIES  # the text operators have tests of their own
    return list(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from check import canon
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    res = duck.execute(sql)
    ocols = [d[0] for d in res.description]
    assert canon(df.columns, rows) == canon(ocols, res.fetchall())


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["oid", "pd_class", "overlap_area"]
    assert df.count() == spark.read.parquet(f"{E.SMOKE_DIR}/part.parquet").count()
