"""Run reports: what each step did to the number of rows and of missing cells."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegate.functions.missing import data_columns, is_missing


def _metrics(df: DataFrame) -> dict[str, Column]:
    """Metric name -> aggregate."""
    missing = [F.count_if(is_missing(df, name)) for name in data_columns(df)]
    return {"rows": F.count("*"), "nulls": sum(missing[1:], missing[0]) if missing else F.lit(0)}


def step_metrics(step: str, op: str, df: DataFrame) -> DataFrame:
    """``(step, op, metric, value)`` of one step's output, exactly, from one aggregate."""
    metrics = _metrics(df)
    values = df.agg(*[value.cast("long").alias(name) for name, value in metrics.items()])
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics]
    return values.select(
        F.lit(step).alias("step"), F.lit(op).alias("op"), F.inline(F.array(*pairs))
    )


def run_report(steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """:func:`step_metrics` of several ``(step, op, output)``, in one table."""
    return reduce(DataFrame.unionAll, [step_metrics(*step) for step in steps])


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and missing cells while ``df`` is computed for something else.

    Costs no extra job. A task that is run again before a shuffle counts twice, so after lost
    executors these numbers may be too high; :func:`step_metrics` is exact.
    """
    observation = Observation(name)
    metrics = [value.cast("long").alias(metric) for metric, value in _metrics(df).items()]
    return df.observe(observation, *metrics), observation


def observed_report(spark, steps: list[tuple[str, str, Observation]]) -> DataFrame:
    """``(step, op, metric, value)`` of observations whose job has run."""
    rows = [
        (step, op, metric, value)
        for step, op, observation in steps
        for metric, value in observation.get.items()
    ]
    return spark.createDataFrame(rows, "step string, op string, metric string, value long")
