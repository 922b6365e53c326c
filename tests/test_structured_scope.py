"""Queries of the structured route keep all their rows."""

import pytest

from docloom.operators import sqlguard
from docloom.plans import catalog


@pytest.mark.parametrize("name", ["nl2sql_window", "rows_to_markdown", "nl2sql_join", "nl2sql_rollup"])
def test_no_row_cap(spark, sf, name):
    assert "Limit" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_guard_without_a_cap(spark):
    t = {"people": spark.range(300)}
    assert sqlguard.run(spark, "select id from people", t, max_rows=None).count() == 300
    assert sqlguard.run(spark, "select id from people", t).count() == 200
