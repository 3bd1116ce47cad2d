"""Duplicate rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.functions.missing import (
    ORDER_COLUMN, data_columns, nan_to_null, require_columns, row_order, without_nan,
)


def _keys(df: DataFrame, subset: list[str] | None) -> list[Column]:
    """Key columns; NULL and NaN are the same missing value."""
    return [without_nan(df, name) for name in require_columns(df, subset or data_columns(df))]


def drop_duplicates(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | bool = "first",
    order_by: str | list[str] | None = None,
) -> DataFrame:
    """Keep the first or last row of each key, or with ``keep=False`` only rows without a twin.

    Every variant reduces a key to one row per input partition before its shuffle, so a key
    that holds a large share of all rows costs no more than any other.
    """
    if keep not in ("first", "last", False):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}.")
    keys = _keys(df, subset)
    if keep is False:
        return _drop_all_repeated(df, keys)
    if subset is None and ORDER_COLUMN not in df.columns and order_by is None:
        # Whole rows are the key, so it does not matter which copy stays.
        return nan_to_null(df).dropDuplicates()
    order = row_order(df, order_by)
    if keep == "last":
        order = [col.desc() for col in order]
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def _drop_all_repeated(df: DataFrame, keys: list[Column]) -> DataFrame:
    names = [f"_key{i}" for i in range(len(keys))]
    grouped = df.groupBy(*[key.alias(name) for key, name in zip(keys, names)])
    rows = grouped.agg(F.count("*").alias("_n"), F.first(F.struct("*")).alias("_row"))
    return rows.where("_n = 1").select("_row.*")


def dedupe_report(
    df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first"
) -> DataFrame:
    """``(initial_rows, final_rows, rows_removed)``, exactly, from the key columns alone."""
    counts = df.groupBy(*_keys(df, subset)).agg(F.count("*").alias("_n"))
    kept = F.count_if(F.col("_n") == 1) if keep is False else F.count("*")
    totals = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("initial_rows"), kept.alias("final_rows")
    )
    return totals.withColumn("rows_removed", F.col("initial_rows") - F.col("final_rows"))
