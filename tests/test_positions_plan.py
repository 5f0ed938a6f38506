"""Events are joined to their own rows without a copy of all events in the driver."""

import re

import pytest

from aeroband.plans import catalog, registry


@pytest.mark.parametrize("name", ["m26_fix_statistics", "m17_linear_fix_2d", "m20_position_residuals"])
def test_events_are_not_broadcast(spark, tmp_path, name):
    catalog.load()
    spark.range(600).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr("id AS s_suppkey", "id * 10.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.run(name, spark, str(tmp_path))
    joins = re.findall(r"(\w+Join) \[event_id#", df._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    rows = df.collect()
    assert rows[0].total == rows[0].converged == 600 if name.startswith("m26") else len(rows) == 600
