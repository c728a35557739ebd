"""Monthly series follow the table to its end."""

import datetime

import pytest

from faultline.sources import tables


@pytest.mark.parametrize("last,months", [("2002-02-28", 8), ("2002-02-27", 7)])
def test_whole_months_after_july_2001_count(spark, tmp_path, last, months):
    days = [datetime.datetime(2001, m, 15) for m in range(7, 13)] + [datetime.datetime(2002, 1, 15), datetime.datetime.fromisoformat(last)]
    spark.createDataFrame([(1, 1e6, t) for t in days], "o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert tables.monthly(spark, str(tmp_path)).count() == months
