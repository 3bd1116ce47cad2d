"""Gates that judge groups of rows, such as landed files, each by itself within one plan.

Every function returns the groups that a gate would refuse as ``(*by, message)``; the message is the
one that the gate of a table raises.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidegate.functions.missing import column
from tidegate.operators import quality
from tidegate.operators.validate_json import ERRORS



def _joined(failures: DataFrame, by: list[str], title: str) -> DataFrame:
    """One message per group, from ``(*by, rule_idx, text)``: a row per failed rule."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rule_idx", "text"))), lambda x: x["text"])
    return failures.groupBy(*by).agg(
        F.concat(F.lit(f"{title}:\n- "), F.array_join(texts, "\n- ")).alias("message")
    )


def _failures(counts: DataFrame, by: list[str], texts: dict[int, Column]) -> DataFrame:
    """``(*by, rule_idx, text)`` of the rules whose count ``_v<idx>`` is not zero."""
    rows = [
        F.when(F.col(f"_v{i}") > 0, F.struct(F.lit(i).alias("rule_idx"), text.alias("text")))
        for i, text in texts.items()
    ]
    return counts.select(*by, F.inline(F.array_compact(F.array(*rows))))


def quality_failures(df: DataFrame, rules: list[dict], by: list[str]) -> DataFrame:
    """``(*by, message)`` of the groups that break rules (see :func:`quality.quality_report`).

    All row rules share one scan. A value is unique if it occurs once within its group; values are
    counted by group and value, so that a large group is spread over many tasks.
    """
    quality._check_rules(df, rules)
    text = {i: F.lit(quality.rule_message(Row(**rule))) for i, rule in enumerate(rules)}
    row_rules = {i: r for i, r in enumerate(rules) if r["type"] in quality.ROW_RULES}
    unique = {i: r for i, r in enumerate(rules) if r["type"] == "is_unique"}
    unknown = [i for i in range(len(rules)) if i not in row_rules and i not in unique]
    parts = []
    if row_rules or unknown:
        sums = [F.count_if(quality._violates(df, rule)).alias(f"_v{i}") for i, rule in row_rules.items()]
        counts = df.groupBy(*by).agg(F.count("*").alias("_rows"), *sums)
        counts = counts.withColumns({f"_v{i}": F.lit(1) for i in unknown})
        parts.append(_failures(counts, by, {i: text[i] for i in [*row_rules, *unknown]}))
    if unique:
        cells = [
            F.struct(F.lit(i).alias("_rule"), quality._as_key(df, rule["column"]).alias("_key"))
            for i, rule in unique.items()
        ]
        values = df.select(*by, F.inline(F.array(*cells))).groupBy(*by, "_rule", "_key")
        repeated = values.agg(F.count("*").alias("_n")).filter("_n > 1")
        sums = [F.count_if(F.col("_rule") == i).alias(f"_v{i}") for i in unique]
        parts.append(_failures(repeated.groupBy(*by).agg(*sums), by, {i: text[i] for i in unique}))
    if not parts:
        return df.select(*by, F.lit("").alias("message")).limit(0)
    return _joined(reduce(DataFrame.unionByName, parts), by, "Data quality validation failed")


def business_failures(df: DataFrame, rules: list[dict], by: list[str]) -> DataFrame:
    """``(*by, message)`` of the groups that break business rules."""
    if not rules:
        return df.select(*by, F.lit("").alias("message")).limit(0)
    sums = [F.count_if(quality._business_rule(rule)).alias(f"_v{i}") for i, rule in enumerate(rules)]
    texts = {}
    for i, rule in enumerate(rules):
        before, after = quality.rule_message(Row(**rule, violations="\0")).split("\0")
        texts[i] = F.concat(F.lit(before), F.col(f"_v{i}").cast("string"), F.lit(after))
    counts = df.groupBy(*by).agg(*sums)
    return _joined(_failures(counts, by, texts), by, "Business rule validation failed")


def row_failures(violations: DataFrame, title: str, by: list[str], show: int = 20) -> DataFrame:
    """``(*by, message)`` of the groups with bad rows, given with ``_errors``; quotes ``show`` rows of each."""
    text = F.array_join(ERRORS, ", ")
    marked = violations.select(*by, text.alias("text"))
    counts = marked.groupBy(*by).agg(F.count("*").alias("rows"))
    first = Window.partitionBy(*by).orderBy("text")
    quoted = marked.withColumn("rule_idx", F.row_number().over(first)).filter(F.col("rule_idx") <= show)
    quoted = quoted.groupBy(*by).agg(F.sort_array(F.collect_list("text")).alias("texts"))
    head = F.concat(F.lit(f"{title} for "), F.col("rows").cast("string"), F.lit(" records:\n- "))
    return counts.join(quoted, by).select(*by, F.concat(head, F.array_join("texts", "\n- ")).alias("message"))


def malformed_failures(df: DataFrame, mark: str, by: list[str]) -> DataFrame:
    """``(*by, message)`` of the groups that hold rows whose column ``mark`` is not null."""
    bad = df.filter(column(mark).isNotNull()).groupBy(*by)
    counted = bad.agg(F.count("*").alias("rows"), F.min(F.substring(column(mark), 1, 200)).alias("first"))
    return counted.select(
        *by, F.concat(F.lit("Malformed records: "), F.col("rows").cast("string"), F.lit(", such as: "), "first").alias("message")
    )
