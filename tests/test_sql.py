"""SQL text whose correlated subqueries are large."""

import pytest

from tidegate.operators.sql import sql_transform

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
ABOVE_MEAN = """WITH typical AS (SELECT k AS own, avg(v) AS mean FROM source_data GROUP BY k)
    SELECT id FROM source_data r WHERE v > (SELECT mean FROM typical WHERE own = r.k) AND v < (SELECT 9)"""


@pytest.fixture
def large(spark):
    """Takes every table as too large for a broadcast."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield spark
    spark.conf.set(THRESHOLD, before)


def test_correlated_subquery_has_no_nested_loop(large):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 5.0), (4, None, 7.0), (5, "c", None), (6, "a", 3.0), (6, "a", 3.0)]
    df = sql_transform(large.createDataFrame(rows, "id long, k string, v double"), ABOVE_MEAN)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in df.collect()) == [6, 6]
    assert sorted(r.id for r in df.filter("id > 1").collect()) == [6, 6]


def test_selected_subquery(large):
    df = large.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    names = large.createDataFrame([("a", "A"), ("c", "C")], "own string, name string")
    found = sql_transform(df, "SELECT id, (SELECT name FROM names WHERE own = k) AS name FROM source_data", views={"names": names})
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.name) for r in found.collect()) == [(1, "A"), (2, None), (3, None)]


def test_two_rows_are_an_error(large):
    df = large.createDataFrame([(1, "a"), (2, "a")], "id long, k string")
    sql = "WITH x AS (SELECT k AS own, id AS n FROM source_data) SELECT id FROM source_data r WHERE id > (SELECT n FROM x WHERE own = r.k)"
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        sql_transform(df, sql).collect()
