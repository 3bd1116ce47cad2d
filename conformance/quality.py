"""Data-quality rules."""

from pyspark.sql import functions as F

from conformance import Query, table
from conformance.cleansing import GAPPY, _gappy
from tidegate.operators.quality import (
    business_report, fail_on_invalid, gate, quality_report, split_invalid, with_violations,
)

ORDER_RULES = [
    {"column": "o_orderkey", "type": "not_null"},
    {"column": "o_orderkey", "type": "is_unique"},
    {"column": "o_custkey", "type": "is_unique"},
    {"column": "o_totalprice", "type": "in_range", "min": 1000, "max": 400000},
    {"column": "o_totalprice", "type": "in_range", "min": 50000},
    {"column": "o_orderpriority", "type": "matches_regex", "pattern": r"[1-3]-\w+$"},
    {"column": "o_orderstatus", "type": "in_set", "values": ["O", "F"]},
    {"column": "o_custkey", "type": "in_set", "values": ["1", "2"]},
    {"column": "o_orderdate", "type": "in_range", "max": "2000-01-01"},
    {"column": "o_orderkey", "type": "sparkles"},
]
_ORDER_COUNTS = [
    "count(*) FILTER (o_orderkey IS NULL)",
    "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) WHERE n > 1)",
    "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 1)",
    "count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000)",
    "count(*) FILTER (o_totalprice < 50000)",
    "count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-\\w+$'))",
    "count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))",
    "count(o_custkey)",
    "count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-01')",
    "1",  # a rule of unknown type is one violation
]
_ORDER_REPORT = " UNION ALL ".join(
    f"""SELECT {i} AS rule_idx, '{rule["column"]}' AS "column", '{rule["type"]}' AS type,
        CAST(max(n) AS BIGINT) AS violations, max(n) = 0 AS passed
        FROM (SELECT {count} AS n FROM orders)"""
    for i, (rule, count) in enumerate(zip(ORDER_RULES, _ORDER_COUNTS))
)

GAP_RULES = [
    {"column": "value", "type": "not_null"},
    {"column": "event_type", "type": "is_unique"},
    {"column": "value", "type": "in_range", "min": 10, "max": 40},
]

ROW_RULES = [
    {"column": "o_totalprice", "type": "in_range", "max": 400000},
    {"column": "o_orderpriority", "type": "matches_regex", "pattern": "[1-4]-"},
    {"name": "cheap open order", "expression": "o_orderstatus == 'O' and o_totalprice < 20000"},
]
_VIOLATIONS = """concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'o_totalprice:in_range' END,
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'o_orderpriority:matches_regex' END,
    CASE WHEN o_orderstatus = 'O' AND o_totalprice < 20000 THEN 'cheap open order' END)"""

LINE_RULES = [
    {"name": "returned while open", "expression": "l_returnflag in ('R', 'A') and l_linestatus == 'O'"},
    {"name": "discount above tax", "expression": "l_discount > l_tax * 2 or not (l_quantity > 1)"},
    {"name": "no such line", "expression": "l_linenumber < 0"},
]
_LINE_PREDICATES = [
    "l_returnflag IN ('R', 'A') AND l_linestatus = 'O'",
    "l_discount > l_tax * 2 OR NOT (l_quantity > 1)",
    "l_linenumber < 0",
]
_LINE_REPORT = " UNION ALL ".join(
    f"""SELECT {i} AS rule_idx, '{rule["name"]}' AS name, '{rule["expression"].replace("'", "''")}' AS expression,
        count(*) FILTER ({predicate}) AS violations, count(*) FILTER ({predicate}) = 0 AS passed FROM lineitem"""
    for i, (rule, predicate) in enumerate(zip(LINE_RULES, _LINE_PREDICATES))
)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _passed(spark, sf_dir):
    df = _orders(spark, sf_dir)
    rules = [
        {"column": "o_orderkey", "type": "not_null"},
        {"column": "o_orderkey", "type": "is_unique"},
        {"column": "o_totalprice", "type": "in_range", "min": 0},
    ]
    return gate(df, quality_report(df, rules))


def _invalid(spark, sf_dir):
    invalid = split_invalid(_orders(spark, sf_dir), ROW_RULES)[1]
    return invalid.select("o_orderkey", F.array_join("_violations", ",").alias("broken"))


def _line_rows(spark, sf_dir):
    marked = with_violations(table(spark, sf_dir, "lineitem"), LINE_RULES)
    return marked.where(F.size("_violations") > 0).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join("_violations", ",").alias("broken")
    )


QUERIES = {
    "dq_report": Query(lambda s, d: quality_report(_orders(s, d), ORDER_RULES), _ORDER_REPORT),
    "dq_report_missing": Query(
        lambda s, d: quality_report(_gappy(s, d), GAP_RULES),
        f"""SELECT 0 AS rule_idx, 'value' AS "column", 'not_null' AS type, count(*) FILTER (value IS NULL) AS violations,
                count(*) FILTER (value IS NULL) = 0 AS passed FROM {GAPPY}
            UNION ALL SELECT 1, 'event_type', 'is_unique', CAST(coalesce(sum(n), 0) AS BIGINT), coalesce(sum(n), 0) = 0
                FROM (SELECT count(*) AS n FROM {GAPPY} GROUP BY event_type) WHERE n > 1
            UNION ALL SELECT 2, 'value', 'in_range', count(*) FILTER (value < 10 OR value > 40),
                count(*) FILTER (value < 10 OR value > 40) = 0 FROM {GAPPY}""",
    ),
    "dq_gate": Query(_passed, "SELECT * FROM orders"),
    "dq_fail_on_invalid": Query(
        lambda s, d: fail_on_invalid(_orders(s, d), [{"column": "o_totalprice", "type": "in_range", "min": 0}]),
        "SELECT * FROM orders",
    ),
    "dq_split_valid": Query(
        lambda s, d: split_invalid(_orders(s, d), ROW_RULES)[0],
        f"SELECT * FROM orders WHERE {_VIOLATIONS} = ''",
    ),
    "dq_split_invalid": Query(
        _invalid, f"SELECT o_orderkey, {_VIOLATIONS} AS broken FROM orders WHERE {_VIOLATIONS} <> ''"
    ),
    "business_rules_report": Query(
        lambda s, d: business_report(table(s, d, "lineitem"), LINE_RULES), _LINE_REPORT
    ),
    "business_rules_rows": Query(
        _line_rows,
        f"""SELECT l_orderkey, l_linenumber, l_partkey,
                concat_ws(',', CASE WHEN {_LINE_PREDICATES[0]} THEN 'returned while open' END,
                    CASE WHEN {_LINE_PREDICATES[1]} THEN 'discount above tax' END) AS broken
            FROM lineitem WHERE ({_LINE_PREDICATES[0]}) OR ({_LINE_PREDICATES[1]})""",
    ),
}
