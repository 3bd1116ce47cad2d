"""Missing values: NULL, and NaN in floating-point columns."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_COLUMN = "_file_order"


def quoted(name: str) -> str:
    """A column name quoted for ``F.col``, so that dots in it are not read as field access."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def data_columns(df: DataFrame) -> list[str]:
    """The columns of ``df`` without the hidden row-order column."""
    return [name for name in df.columns if name != ORDER_COLUMN]


def require_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    unknown = [name for name in names if name not in df.columns]
    if unknown:
        raise KeyError(f"Columns not found: {unknown}. Available: {df.columns}")
    return names


def _is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_missing(df: DataFrame, name: str) -> Column:
    col = column(name)
    return (col.isNull() | F.isnan(col)) if _is_floating(df.schema[name].dataType) else col.isNull()


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    col = column(name)
    dtype = df.schema[name].dataType
    return F.nanvl(col, F.lit(None).cast(dtype)) if _is_floating(dtype) else col


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column.

    Filters on such a column no longer reach the file scan, so this is opt-in; the
    operators of this package treat NaN as missing without it.
    """
    floating = [f.name for f in df.schema.fields if _is_floating(f.dataType)]
    return df.withColumns({name: without_nan(df, name) for name in floating}) if floating else df


def row_order(df: DataFrame, order_by: str | list[str] | None) -> list[Column]:
    """Ordering columns: ``order_by``, or the order rows had in their file."""
    if order_by:
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        return [column(name) for name in require_columns(df, names)]
    if ORDER_COLUMN in df.columns:
        return [F.col(ORDER_COLUMN)]
    raise ValueError(
        "Rows have no order here: pass order_by=, or read the table with row_order=True."
    )
