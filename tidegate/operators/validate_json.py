"""Validators over JSON: a schema on one column, NGSI rules on entity lines."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.errors import DataQualityError
from tidegate.functions.json_schema import add_schema_errors
from tidegate.functions.json_text import computed_once, variant_entries, with_json_values
from tidegate.functions.missing import ORDER_COLUMN, column, require_columns, row_order, without_nan
from tidegate.functions.ngsi import entity_errors
from tidegate.functions.patterns import is_blank

ERRORS = "_errors"


_VALUE = "_value"


def _with_value(df: DataFrame, name: str) -> DataFrame:
    """Add the JSON value of a cell; a missing cell is JSON null, a malformed one is NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        df = with_json_values(df, {_VALUE: column(name)})
        value = F.col(_VALUE)
    elif isinstance(dtype, T.VariantType):
        value = column(name)
    elif isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        value = F.try_parse_json(F.to_json(column(name), {"ignoreNullFields": "false"}))
    else:
        value = without_nan(df, name).cast("variant")
    missing = without_nan(df, name).isNull()
    return df.withColumn(_VALUE, F.when(missing, F.parse_json(F.lit("null"))).otherwise(value))


def with_schema_errors(df: DataFrame, target_column: str, schema: dict | str) -> DataFrame:
    """Add ``_errors``, the list of violations of a JSON Schema in each cell of the column."""
    require_columns(df, [target_column])
    schema = json.loads(schema) if isinstance(schema, str) else schema
    malformed = F.when(F.col(_VALUE).isNull(), F.array(F.lit("Invalid JSON string.")))
    checked = add_schema_errors(_with_value(df, target_column), _VALUE, schema, ERRORS, malformed)
    return checked.drop(_VALUE)  # gone already if the schema is recursive


def schema_violations(df: DataFrame, target_column: str, schema: dict | str) -> DataFrame:
    """The rows whose cell breaks the schema, with ``_errors``."""
    return with_schema_errors(df, target_column, schema).where(F.size(ERRORS) > 0)


def with_ngsi_errors(df: DataFrame, line_column: str = "value", ngsi_version: str = "ld") -> DataFrame:
    """Add ``_errors`` to entity lines; blank lines hold no entity and have no errors."""
    line = column(line_column)
    entity, entries = F.col("_entity"), F.col("_entries")
    staged = with_json_values(df, {"_entity": line}).withColumn("_entries", variant_entries(entity))
    blank = F.coalesce(is_blank(line), F.lit(True))
    errors = (
        F.when(blank, F.array().cast("array<string>"))
        .when(entity.isNull(), F.array(F.lit("Invalid JSON format.")))
        .when(entries.isNull(), F.array(F.lit("Entity must be a JSON object.")))
        .otherwise(entity_errors(entries, ngsi_version))
    )
    return computed_once(staged, ERRORS, errors).drop("_entity", "_entries")


def ngsi_violations(df: DataFrame, line_column: str = "value", ngsi_version: str = "ld") -> DataFrame:
    """The entity lines that break the rules, with ``_errors``."""
    return with_ngsi_errors(df, line_column, ngsi_version).where(F.size(ERRORS) > 0)


def first_violation(violations: DataFrame, order_by: str | list[str] | None = None) -> DataFrame:
    """The first bad row in row order, with all its errors: a stop at the first error."""
    return violations.orderBy(*row_order(violations, order_by)).limit(1)


def gate_rows(df: DataFrame, violations: DataFrame, title: str, show: int = 20) -> DataFrame:
    """Return ``df`` unchanged if there are no bad rows, else raise.

    The message counts all bad rows and quotes the errors of a few; ``violations`` holds the rest.
    """
    count = violations.count()
    if count:
        order = [ORDER_COLUMN] if ORDER_COLUMN in violations.columns else []
        quoted = violations.orderBy(*order).limit(show) if order else violations.limit(show)
        lines = [", ".join(row[ERRORS]) for row in quoted.select(ERRORS).collect()]
        raise DataQualityError(f"{title} for {count} records:\n- " + "\n- ".join(lines))
    return df
