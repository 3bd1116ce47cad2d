"""What the plans must look like for large tables."""

import pytest

from tidegate.functions.json_render import render_json
from tidegate.operators.dedupe import dedupe_report, drop_duplicates
from tidegate.operators.nulls import carry, drop_nulls, fill_nulls, null_census
from tidegate.operators.quality import business_report, with_violations
from tidegate.operators.sql import sql_transform
from tidegate.operators.validate_json import schema_violations


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def test_filters_and_columns_reach_the_scan(events):
    found = plan(sql_transform(events, "SELECT event_id FROM source_data WHERE value > 90 AND user_id = 3"))
    assert "PushedFilters: [IsNotNull(value), IsNotNull(user_id), GreaterThan(value,90.0), EqualTo(user_id,3)]" in found
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in found


def test_a_chain_keeps_pushdown(events):
    chain = fill_nulls(events, {"event_type": "none"})
    found = plan(chain.where("user_id = 3").select("event_type"))
    assert "EqualTo(user_id,3)" in found and "ReadSchema: struct<user_id:bigint,event_type:string>" in found


def test_row_operators_do_not_shuffle(events):
    rules = [{"column": "value", "type": "in_range", "min": 0}]
    for df in (
        drop_nulls(events),
        fill_nulls(events, 0),
        with_violations(events, rules),
        schema_violations(events, "props", {"required": ["k"]}),
        render_json(events, '{"id": {{ event_id }}}'),
    ):
        assert "Exchange" not in plan(df)


def test_reports_read_only_their_columns(events):
    assert "ReadSchema: struct<value:double>" in plan(null_census(events, ["value"]))
    assert "ReadSchema: struct<user_id:bigint>" in plan(dedupe_report(events, ["user_id"]))
    rules = [{"name": "a", "expression": "value < 0"}, {"name": "b", "expression": "user_id < 0"}]
    found = plan(business_report(events, rules))
    assert found.count("FileScan") == 1
    assert "ReadSchema: struct<user_id:bigint,value:double>" in found


def test_rows_are_checked_once(events):
    """The filter on the errors does not repeat the checks."""
    found = plan(schema_violations(events, "props", {"required": ["k"]}).select("event_id"))
    assert found.count("is a required property") == 1
    assert found.count("parseJson") == 1


def test_whole_table_fill_has_no_single_partition(events):
    found = plan(carry(events.select("event_id", "value"), "ffill", "event_id", buckets=8))
    # The only one holds a row per bucket, out of the aggregate below it.
    below = found.split("SinglePartition")
    assert len(below) == 2 and "max_by" in below[1].splitlines()[1]


def test_one_shuffle_per_duplicate_search(events):
    for keep in ("first", "last", False):
        found = plan(drop_duplicates(events, ["user_id"], keep, "event_id"))
        assert found.count("Exchange") == 1
