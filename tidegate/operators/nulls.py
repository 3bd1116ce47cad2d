"""Missing values: drop, fill, carry forward or backward, count."""

import datetime
import decimal
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.missing import (
    ORDER_COLUMN, column, data_columns, is_missing, quoted, require_columns, row_order, without_nan,
)
from tidegate.scratch import checkpoint_dir

FORWARD = ("ffill", "pad")
BACKWARD = ("bfill", "backfill")

# Up to here an overfull bucket does no harm.
FEW_ROWS = 100_000
ROWS_PER_BUCKET = 5_000_000
SAMPLE_PER_BUCKET = 100
# A heavy group is one of at most rows / hot_rows; this many keys may be broadcast.
BROADCAST_GROUPS = 100_000


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows in which any of the columns is missing."""
    names = require_columns(df, subset or data_columns(df))
    return df.na.drop(subset=[quoted(name) for name in names])


def _filled(df: DataFrame, name: str, value) -> Column | None:
    """The column with its gaps filled, or None if the value does not fit its type."""
    dtype = df.schema[name].dataType
    col = without_nan(df, name)
    integral = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if isinstance(value, bool):
        fits = isinstance(dtype, T.BooleanType)
    elif isinstance(value, int) and integral:
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dtype)]
        if not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1):
            dtype = T.LongType() if -(2**63) <= value < 2**63 else T.DoubleType()
        fits = True
    elif isinstance(value, (int, float, decimal.Decimal)):
        if integral:
            # An integer column that takes a fraction becomes a floating-point column.
            dtype = dtype if float(value).is_integer() else T.DoubleType()
        elif isinstance(dtype, T.DecimalType):
            exact = decimal.Decimal(str(value)).normalize().as_tuple()
            whole = len(exact.digits) + exact.exponent
            if -exact.exponent > dtype.scale or whole > dtype.precision - dtype.scale:
                return None
        fits = isinstance(dtype, T.NumericType)
    elif isinstance(value, str):
        fits = isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))
    elif isinstance(value, datetime.datetime):
        fits = isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    else:
        fits = isinstance(value, datetime.date) and isinstance(dtype, T.DateType)
    return F.coalesce(col.cast(dtype), F.lit(value).cast(dtype)) if fits else None


def fillable_columns(df: DataFrame, value) -> list[str]:
    """The columns a scalar fill changes: those whose type can hold the value."""
    return [name for name in data_columns(df) if _filled(df, name, value) is not None]


def fill_nulls(df: DataFrame, value) -> DataFrame:
    """Fill gaps with a scalar in all columns that can hold it, or per column from a dict."""
    if value is None:
        raise ValueError("A fill needs a value.")
    if isinstance(value, dict):
        known = {name: v for name, v in value.items() if name in df.columns}
        filled = {name: _filled(df, name, v) for name, v in known.items()}
        bad = [name for name, col in filled.items() if col is None]
        if bad:
            raise TypeError(f"The fill values do not fit the types of columns {bad}.")
    else:
        filled = {name: _filled(df, name, value) for name in fillable_columns(df, value)}
        if not filled:
            raise TypeError(f"No column can hold the fill value {value!r}.")
    return df.select(*[filled.get(n, column(n)).alias(n) for n in df.columns])


def _span(df: DataFrame, name: str) -> Column:
    """An ordering column as a number that keeps the order."""
    dtype = df.schema[name].dataType
    col = column(name)
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # Not by way of a time zone, where clock changes would break the order.
        days = F.unix_date(col.cast("date")).cast("double")
        seconds = F.extract(F.lit("SECOND"), col).cast("double")
        return ((days * 24 + F.hour(col)) * 60 + F.minute(col)) * 60 + seconds
    return col.cast("double")


def _by_quantiles(df: DataFrame, name: str, buckets: int, rows: int) -> DataFrame | None:
    """Add ``_bucket`` by equally filled ranges of one numeric or time column.

    The bounds come from a sample and become fixed numbers in the plan, so a recomputed task
    puts every row in the same bucket again. Returns None if a single value, or NULL, covers so
    many rows that its bucket would be overfull.
    """
    span = _span(df, name)
    spans = df.select(span.alias("_span"))
    if rows > SAMPLE_PER_BUCKET * buckets:
        spans = spans.sample(SAMPLE_PER_BUCKET * buckets / rows, seed=1)
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    found = spans.agg(
        F.percentile_approx("_span", F.array(*map(F.lit, shares)), 20 * buckets).alias("splits"),
        (F.count("_span") / F.count("*")).alias("known"),
    ).first()
    splits = found["splits"] or [0.0]
    finite = sorted({split for split in splits if abs(split) < float("inf")})
    crowded = len(finite) < len(splits) or (found["known"] or 0) < 1 - 1 / buckets
    if not finite or (crowded and rows > FEW_ROWS):
        return None
    ranges = Bucketizer(
        splits=[float("-inf"), *finite, float("inf")],
        inputCol="_span", outputCol="_bucket", handleInvalid="keep",
    )
    return (
        ranges.transform(df.withColumn("_span", F.coalesce(span, F.lit(float("-inf")))))
        .withColumn("_bucket", F.struct(F.col("_bucket").cast("long").alias("range")))
        .drop("_span")
    )


def _by_range_partitions(df: DataFrame, order: list[Column], buckets: int) -> DataFrame:
    """Add ``_bucket`` by range partitions over the whole ordering key.

    Splits also runs of equal leading values. The result is checkpointed: the partition bounds
    come from a sample, and only stored rows keep their bucket when a task is run again.
    """
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(buckets, *order)
    return ranged.withColumn("_bucket", F.struct(F.spark_partition_id().alias("range"))).checkpoint()


def _bucketed(
    df: DataFrame, order_by: list[str] | None, buckets: int | None, rows: int | None = None
) -> DataFrame:
    """Add ``_bucket``: ranges of the row order, each of a size that one task can sort."""
    if order_by is None:
        position = F.col(ORDER_COLUMN)
        return df.withColumn("_bucket", F.struct(position["file"], position["block"]))
    rows = df.count() if rows is None else rows
    if buckets is None:
        at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(at_least, math.ceil(rows / ROWS_PER_BUCKET))
    lead = df.schema[order_by[0]].dataType
    if isinstance(lead, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        ranged = _by_quantiles(df, order_by[0], buckets, rows)
        if ranged is not None:
            return ranged
    return _by_range_partitions(df, [column(name) for name in order_by], buckets)


def carry(
    df: DataFrame,
    method: str = "ffill",
    order_by: str | list[str] | None = None,
    columns: list[str] | None = None,
    partition_by: list[str] | None = None,
    buckets: int | None = None,
    hot_rows: int = 20_000_000,
) -> DataFrame:
    """Fill each gap with the last known value before it (ffill) or after it (bfill).

    ``order_by`` must name a total order. Rows are cut into ``buckets`` ranges of that order
    (by default as many as there are shuffle partitions, and more for large tables); the last
    known values of the ranges are carried from range to range, and within a range a window does
    the rest. So a fill over the whole table runs in parallel. With ``partition_by``, only
    groups of more than ``hot_rows`` rows are cut; smaller ones are one window each.
    """
    if method not in FORWARD + BACKWARD:
        raise ValueError(f"method must be one of {FORWARD + BACKWARD}, not {method!r}.")
    groups = require_columns(df, partition_by or [])
    order = row_order(df, order_by)
    order_by = [order_by] if isinstance(order_by, str) else order_by
    fixed = set(groups) | set(order_by or [])
    names = require_columns(df, columns or [n for n in data_columns(df) if n not in fixed])
    if not names:
        raise ValueError("There is no column to fill.")

    if not groups:
        return _carry_across(_bucketed(df, order_by, buckets), df.columns, method, names, [], order)
    heavy = df.groupBy(*[column(g).alias(f"_heavy{i}") for i, g in enumerate(groups)])
    checkpoint_dir(df.sparkSession)
    heavy = heavy.agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).checkpoint()
    found = heavy.agg(F.count("*").alias("groups"), F.sum("_n").alias("rows")).first()
    if not found.groups:
        return _carry_within(df, method, names, map(column, groups), order)
    heavy = F.broadcast(heavy.drop("_n")) if found.groups <= BROADCAST_GROUPS else heavy.drop("_n")
    same = [F.col(f"_heavy{i}").eqNullSafe(column(g)) for i, g in enumerate(groups)]
    light = df.join(heavy, same, "left_anti")
    light = _carry_within(light, method, names, map(column, groups), order)
    rest = _bucketed(df.join(heavy, same, "left_semi"), order_by, buckets, found.rows)
    return light.unionByName(_carry_across(rest, df.columns, method, names, groups, order))


def _facing(method: str, order: list[Column]) -> list[Column]:
    """The order in which the last known value is the one to carry.

    Carrying backward is carrying forward through the reversed order; a frame that looks ahead
    would be evaluated anew for every row.
    """
    return order if method in FORWARD else [col.desc() for col in order]


def _carry_within(df, method, names, keys, order) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*_facing(method, order))
    window = window.rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({n: F.last(without_nan(df, n), True).over(window) for n in names})


def _carry_across(source, output, method, names, groups, order) -> DataFrame:
    edge = F.max_by if method in FORWARD else F.min_by
    position = F.struct(*order)  # a NULL ordering key has a place, too
    keys = [*map(column, groups), F.col("_bucket")]

    # The known value nearest to the edge of each bucket; partial aggregates go over the network.
    known = source.groupBy(*keys).agg(
        *[
            edge(value, F.when(value.isNotNull(), position)).alias(f"_edge{i}")
            for i, value in enumerate(without_nan(source, n) for n in names)
        ]
    )
    # One row per bucket, so this window stays small also when it has no partitions.
    over_buckets = W.partitionBy(*map(column, groups)) if groups else W.partitionBy(F.lit(0))
    over_buckets = over_buckets.orderBy(*_facing(method, [F.col("_bucket")]))
    over_buckets = over_buckets.rowsBetween(W.unboundedPreceding, -1)
    carried = known.select(
        *[column(g).alias(f"_group{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_at"),
        *[F.last(f"_edge{i}", True).over(over_buckets).alias(f"_carry{i}") for i in range(len(names))],
    )
    inside = _carry_within(source, method, names, keys, order)
    same = [F.col(f"_group{i}").eqNullSafe(column(g)) for i, g in enumerate(groups)]
    filled = inside.join(carried, [*same, F.col("_at").eqNullSafe(F.col("_bucket"))], "left")
    at = {name: i for i, name in enumerate(names)}
    return filled.select(
        *[
            F.coalesce(column(n), F.col(f"_carry{at[n]}")).alias(n) if n in at else column(n)
            for n in output
        ]
    )


def handle_nulls(
    df: DataFrame, strategy: str, subset=None, value=None, method=None, **carry_options
) -> DataFrame:
    """Drop rows with gaps, or fill gaps with a value or from neighbouring rows."""
    if strategy == "drop_row":
        return drop_nulls(df, subset)
    if strategy != "fill":
        raise ValueError(f"Unsupported strategy: '{strategy}'.")
    if (value is None) == (method is None):
        raise ValueError("A fill needs either a value or a method.")
    return fill_nulls(df, value) if method is None else carry(df, method, **carry_options)


def null_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, nulls)``: missing cells per column, from one scan."""
    names = require_columns(df, columns or data_columns(df))
    counts = df.agg(*[F.count_if(is_missing(df, n)).alias(f"_c{i}") for i, n in enumerate(names)])
    pairs = [F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("nulls")) for i, n in enumerate(names)]
    return counts.select(F.inline(F.array(*pairs)))


def null_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(initial_nulls, final_nulls)``: missing cells before and after a step."""
    initial = null_census(before).agg(F.sum("nulls").alias("initial_nulls"))
    final = null_census(after).agg(F.sum("nulls").alias("final_nulls"))
    # Two tables of exactly one row each.
    return initial.withColumn("_k", F.lit(0)).join(final.withColumn("_k", F.lit(0)), "_k").drop("_k")
