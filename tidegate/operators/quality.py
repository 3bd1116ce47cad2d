"""Data-quality rules over table columns: report, gate, and split into valid and invalid rows."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.errors import DataQualityError
from tidegate.functions.missing import column, is_missing, without_nan
from tidegate.functions.patterns import matches_at_start, python_text

ROW_RULES = ("not_null", "in_range", "matches_regex", "in_set")
REPORT_SCHEMA = "rule_idx int, column string, type string, violations long, passed boolean"


def _check_rules(df: DataFrame, rules: list[dict]) -> None:
    for rule in rules:
        if not rule.get("column") or not rule.get("type"):
            raise ValueError(f"Rule needs 'column' and 'type': {rule}")
        if rule["column"] not in df.columns:
            raise KeyError(f"Column '{rule['column']}' of a rule is not in the table.")


def _in_range(df: DataFrame, rule: dict) -> Column:
    value = column(rule["column"])
    dtype = df.schema[rule["column"]].dataType
    bounds = [rule.get("min"), rule.get("max")]
    for bound in bounds:
        number = isinstance(bound, (int, float)) and not isinstance(bound, bool)
        if number and not isinstance(dtype, (T.NumericType, T.BooleanType)):
            raise TypeError(f"Column '{rule['column']}' is not numeric: {rule}")
        if isinstance(bound, str) and isinstance(dtype, T.NumericType):
            raise TypeError(f"Column '{rule['column']}' is numeric, the bound is text: {rule}")
    if isinstance(dtype, T.BooleanType):
        value = value.cast("int")
    temporal = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    low, high = (F.lit(b).cast(dtype) if temporal and b is not None else F.lit(b) for b in bounds)
    outside = F.lit(False)
    if bounds[0] is not None:
        outside = outside | (value < low)
    if bounds[1] is not None:
        outside = outside | (value > high)
    return outside


def _in_set(df: DataFrame, rule: dict) -> Column:
    values = rule.get("values") or []
    if not values:
        raise ValueError(f"Rule 'in_set' needs 'values': {rule}")
    dtype = df.schema[rule["column"]].dataType
    # A value of another type than the column never matches: the text "1" is not the number 1.
    if isinstance(dtype, T.StringType):
        usable = [v for v in values if isinstance(v, str)]
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        usable = [v for v in values if not isinstance(v, str)]
    else:
        usable = [F.lit(v).cast(dtype) for v in values]
    value = column(rule["column"])
    if isinstance(dtype, T.BooleanType):
        value, usable = value.cast("int"), [int(v) if v in (0, 1) else v for v in usable]
    return ~value.isin(*usable) if usable else F.lit(True)


def _violates(df: DataFrame, rule: dict) -> Column:
    """True for rows that break a row rule; missing values break only ``not_null``."""
    name, kind = rule["column"], rule["type"]
    missing = is_missing(df, name)
    if kind == "not_null":
        return missing
    if kind == "in_range":
        broken = _in_range(df, rule)
    elif kind == "in_set":
        broken = _in_set(df, rule)
    else:
        if not rule.get("pattern"):
            raise ValueError(f"Rule 'matches_regex' needs 'pattern': {rule}")
        text = python_text(column(name), df.schema[name].dataType)
        broken = ~matches_at_start(text, rule["pattern"])
    return ~missing & F.coalesce(broken, F.lit(False))


def _report_row(index: int, rule: dict, violations: Column) -> Column:
    return F.struct(
        F.lit(index).cast("int").alias("rule_idx"),
        F.lit(rule["column"]).alias("column"),
        F.lit(rule["type"]).alias("type"),
        violations.cast("long").alias("violations"),
        (violations == 0).alias("passed"),
    )


def _as_key(df: DataFrame, name: str) -> Column:
    """A text that equal values of a column share, and no others."""
    value, dtype = without_nan(df, name), df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(dtype)  # one zero
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))
    return value.cast("string")


def quality_report(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``(rule_idx, column, type, violations, passed)`` for rules of the types not_null,
    is_unique, in_range, matches_regex and in_set.

    All row rules share one scan of the columns they name, and so do all ``is_unique`` rules:
    those are counts by rule and value, reduced before the shuffle; their violations are the rows whose
    value occurs more than once, with missing values counting as one value. A rule of unknown
    type is a violation.
    """
    _check_rules(df, rules)
    parts, row_rules, unique, unknown = [], [], [], []
    for i, rule in enumerate(rules):
        if rule["type"] in ROW_RULES:
            row_rules.append((i, rule))
        elif rule["type"] == "is_unique":
            unique.append((i, rule))
        else:
            unknown.append((i, rule))
    if unique:
        cells = [
            F.struct(F.lit(i).alias("_rule"), _as_key(df, rule["column"]).alias("_key")) for i, rule in unique
        ]
        counts = df.select(F.inline(F.array(*cells))).groupBy("_rule", "_key").agg(F.count("*").alias("_n"))
        repeated = F.col("_n") > 1
        sums = [
            F.coalesce(F.sum(F.when(repeated & (F.col("_rule") == i), F.col("_n"))), F.lit(0)).alias(f"_v{i}")
            for i, _ in unique
        ]
        rows = [_report_row(i, rule, F.col(f"_v{i}")) for i, rule in unique]
        parts.append(counts.agg(*sums).select(F.inline(F.array(*rows))))
    if row_rules:
        counts = df.agg(*[F.count_if(_violates(df, rule)).alias(f"_v{i}") for i, rule in row_rules])
        rows = [_report_row(i, rule, F.col(f"_v{i}")) for i, rule in row_rules]
        parts.append(counts.select(F.inline(F.array(*rows))))
    if unknown or not parts:
        rows = [(i, rule["column"], rule["type"], 1, False) for i, rule in unknown]
        parts.append(df.sparkSession.createDataFrame(rows, REPORT_SCHEMA))
    return reduce(DataFrame.unionAll, parts)


# Pandas query syntax that means something else, or nothing, in Spark SQL.
_FOREIGN_SYNTAX = {
    r"&": "write 'and' instead of '&'",
    r"\|(?!\|)": "write 'or' instead of '|'",
    r"@": "variables (@name) are not available",
    r"\bin\s*\[": "write 'in (...)' instead of 'in [...]'",
    r"~": "write 'not' instead of '~'",
}


def _business_rule(rule: dict) -> Column:
    if not rule.get("name") or not rule.get("expression"):
        raise ValueError(f"Rule needs 'name' and 'expression': {rule}")
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", rule["expression"])
    for syntax, advice in _FOREIGN_SYNTAX.items():
        if re.search(syntax, bare, flags=re.IGNORECASE):
            raise ValueError(f"Rule '{rule['name']}': {advice}. (Expression: '{rule['expression']}')")
    return F.coalesce(F.expr(rule["expression"]).cast("boolean"), F.lit(False))


def business_report(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``(rule_idx, name, expression, violations, passed)``; each expression is a Spark SQL
    predicate that selects invalid rows. One scan serves all rules."""
    schema = "rule_idx int, name string, expression string, violations long, passed boolean"
    if not rules:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(*[F.count_if(_business_rule(r)).alias(f"_v{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(i).cast("int").alias("rule_idx"),
            F.lit(rule["name"]).alias("name"),
            F.lit(rule["expression"]).alias("expression"),
            F.col(f"_v{i}").alias("violations"),
            (F.col(f"_v{i}") == 0).alias("passed"),
        )
        for i, rule in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _is_business(rule: dict) -> bool:
    return "expression" in rule


def with_violations(df: DataFrame, rules: list[dict], name: str = "_violations") -> DataFrame:
    """Add the list of row rules each row breaks, as ``column:type`` or the business rule's name."""
    _check_rules(df, [rule for rule in rules if not _is_business(rule)])
    labels = []
    for rule in rules:
        if _is_business(rule):
            labels.append(F.when(_business_rule(rule), F.lit(rule["name"])))
        elif rule["type"] in ROW_RULES:
            labels.append(F.when(_violates(df, rule), F.lit(f"{rule['column']}:{rule['type']}")))
        else:
            raise ValueError(f"Not a rule about single rows: {rule}")
    return df.withColumn(name, F.array_compact(F.array(*labels).cast("array<string>")))


def split_invalid(df: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """``(valid, invalid)`` rows; the invalid ones carry ``_violations``."""
    marked = with_violations(df, rules)
    valid = marked.where(F.size("_violations") == 0).drop("_violations")
    return valid, marked.where(F.size("_violations") > 0)


def rule_message(row) -> str:
    """The failure text for one row of a rule report."""
    found = row.asDict()
    if "expression" in found:
        return (
            f"Rule '{row.name}' failed for {row.violations} rows. (Expression: '{row.expression}')."
        )
    # The texts of failed rules.
    texts = {
        "not_null": f"Column '{row.column}' has nulls.",
        "is_unique": f"Column '{row.column}' has duplicates.",
        "in_range": f"Column '{row.column}' has values out of range.",
        "matches_regex": f"Column '{row.column}' has values not matching regex.",
        "in_set": f"Column '{row.column}' has values not in allowed set.",
    }
    return texts.get(row.type, f"Unknown rule type '{row.type}'.")


def gate(df: DataFrame, report: DataFrame, title: str = "Data quality validation failed") -> DataFrame:
    """Return ``df`` unchanged if every rule of the report passed, else raise.

    The report has one row per rule, so its failures are few; computing it reads only the
    columns the rules name.
    """
    failed = report.where(~F.col("passed")).orderBy("rule_idx").collect()
    if failed:
        raise DataQualityError(title + ":\n- " + "\n- ".join(rule_message(row) for row in failed))
    return df


def fail_on_invalid(df: DataFrame, rules: list[dict]) -> DataFrame:
    """A gate inside the plan: the job that uses the result fails at the first invalid row.

    Needs no pass of its own, so a wide table is computed only once.
    """
    marked = with_violations(df, rules)
    message = F.concat(F.lit("Data quality validation failed: "), F.array_join("_violations", ", "))
    checked = F.when(F.size("_violations") == 0, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return marked.where(checked).drop("_violations")


