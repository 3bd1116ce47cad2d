import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.errors import DataQualityError
from tidegate.functions.patterns import java_pattern, matches_at_start, python_text
from tidegate.operators.quality import (
    business_report, fail_on_invalid, gate, quality_report, split_invalid,
)

NAN = float("nan")
SCHEMA = "id long, amt double, code string, ok boolean, at timestamp_ntz"
DATA = [
    (1, 10.0, "A-1", True, datetime.datetime(2024, 1, 1)),
    (None, NAN, "B-2x", None, None),
    (None, -1.0, "xA-3", False, datetime.datetime(2025, 1, 1)),
    (4, 200.0, None, True, None),
    (4, None, "é9", True, None),
]


def report_of(df, *rules):
    return [r.violations for r in quality_report(df, list(rules)).orderBy("rule_idx").collect()]


def test_rules(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    assert report_of(
        df,
        {"column": "amt", "type": "not_null"},
        {"column": "id", "type": "is_unique"},
        {"column": "code", "type": "is_unique"},
        {"column": "amt", "type": "in_range", "min": 0, "max": 100},
        {"column": "amt", "type": "in_range", "min": 0},
        {"column": "amt", "type": "in_range"},
        {"column": "code", "type": "matches_regex", "pattern": r"\w-?\d"},
        {"column": "code", "type": "in_set", "values": ["A-1", "xA-3"]},
        {"column": "id", "type": "in_set", "values": ["1", "4"]},
        {"column": "id", "type": "in_set", "values": [1, 5]},
        {"column": "ok", "type": "in_set", "values": [True]},
        {"column": "ok", "type": "matches_regex", "pattern": "True$"},
        {"column": "at", "type": "in_range", "max": "2024-06-01"},
        {"column": "id", "type": "sparkles"},
    ) == [2, 4, 0, 2, 1, 0, 1, 2, 3, 2, 1, 1, 1, 1]


def test_rule_errors(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    for rule, error in (
        ({"column": "zz", "type": "not_null"}, KeyError),
        ({"type": "not_null"}, ValueError),
        ({"column": "id"}, ValueError),
        ({"column": "code", "type": "matches_regex"}, ValueError),
        ({"column": "code", "type": "in_set", "values": []}, ValueError),
        ({"column": "code", "type": "in_range", "min": 1}, TypeError),
        ({"column": "code", "type": "matches_regex", "pattern": "(?P<n>x)"}, ValueError),
        ({"column": "code", "type": "matches_regex", "pattern": "("}, ValueError),
    ):
        with pytest.raises(error):
            quality_report(df, [rule])
    assert quality_report(df, []).count() == 0


def test_one_scan_for_row_rules(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rules = [
        {"column": "o_orderkey", "type": "not_null"},
        {"column": "o_totalprice", "type": "in_range", "min": 0},
    ]
    plan = quality_report(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_gate(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    good = quality_report(df, [{"column": "amt", "type": "in_range", "max": 500}])
    assert gate(df, good) is df
    bad = quality_report(df, [{"column": "amt", "type": "not_null"}, {"column": "id", "type": "is_unique"}])
    with pytest.raises(DataQualityError, match="(?s)'amt' has nulls.*'id' has duplicates"):
        gate(df, bad)


def test_business_rules(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    rules = [
        {"name": "negative", "expression": "amt < 0"},
        {"name": "text", "expression": "code == 'A & B' or code like 'A%'"},
        {"name": "not one", "expression": "not (id <=> 1)"},
    ]
    report = business_report(df, rules).orderBy("rule_idx")
    assert [(r.name, r.violations, r.passed) for r in report.collect()] == [
        ("negative", 1, False), ("text", 1, False), ("not one", 4, False),
    ]
    with pytest.raises(DataQualityError, match="Rule 'negative' failed for 1 rows"):
        gate(df, report)
    for expression in ("amt < 0 & id > 1", "id in [1, 2]", "id == @x", "~ok", "a | b"):
        with pytest.raises(ValueError):
            business_report(df, [{"name": "bad", "expression": expression}])
    with pytest.raises(ValueError):
        business_report(df, [{"name": "x"}])


def test_split_invalid(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    rules = [
        {"column": "amt", "type": "not_null"},
        {"column": "amt", "type": "in_range", "min": 0, "max": 100},
        {"name": "no code", "expression": "code is null"},
    ]
    valid, invalid = split_invalid(df, rules)
    assert rows(valid.select("code")) == [("A-1",)]
    found = {tuple(r["_violations"]) for r in invalid.collect()}
    assert found == {("amt:not_null",), ("amt:in_range",), ("amt:in_range", "no code")}
    assert valid.columns == df.columns
    with pytest.raises(ValueError):
        split_invalid(df, [{"column": "id", "type": "is_unique"}])


def test_fail_on_invalid(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    fine = fail_on_invalid(df, [{"column": "amt", "type": "in_range", "max": 500}])
    assert rows(fine.select("id")) == rows(df.select("id"))
    with pytest.raises(Exception, match="amt:not_null"):
        fail_on_invalid(df, [{"column": "amt", "type": "not_null"}]).collect()


def test_patterns_agree_with_python(spark):
    import re

    texts = ["abc", "xabc", "é1", "１２", "a\n", "a\r", "a", "", "a b", "A", "tab\t", "line\u2028x", "ABC"]
    patterns = [r"\w\d", r"\d+$", "a$", r"a\Z", "^a", "a.", r"\s", ".*x", "[^a]", "a|x", r"(?i)abc$", r"\\|a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in patterns:
        found = {t for t, hit in rows(df.select("t", matches_at_start(F.col("t"), pattern))) if hit}
        assert found == {t for t in texts if re.match(pattern, t)}, pattern
    for bad in ("[a&&b]", "[[a]", "(?a)x", "a(?(1)b)"):
        with pytest.raises(ValueError):
            java_pattern(bad, anchored=True)


def test_python_text(spark):
    numbers = [0.0, 1.0, -1.5, 1e7, 12345678.9, 1.5e15, 1e16, 1e22, 0.001, 0.00012, 1e-5, 2.5e-300, float("inf"), -float("inf"), NAN]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    texts = df.select("x", python_text(F.col("x"), df.schema["x"].dataType).alias("t")).collect()
    assert [r.t for r in texts] == [str(r.x) for r in texts]
