"""Landed files judged one by one within a micro-batch.

All bodies of a batch run through the steps together, as one plan whose keys hold the body. A gate does
not stop the batch: it finds the bodies that it refuses, in one grouped pass; these leave the plan, and
the others go on to the next step.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators import dedupe, grouped_gates, nulls, validate_json
from tidegate.plans import steps as plans
from tidegate.scratch import scratch_path
from tidegate.streaming.ingest import BODY, MALFORMED, start

#: Refused bodies are broadcast if they are at most so many.
FEW = 100_000
_REFUSED = f"{BODY} string, step string, message string"


def _dedupe(df, subset=None, keep="first", order_by=None):
    return dedupe.drop_duplicates(df, [*subset, BODY] if subset else None, keep, order_by)


def _nulls(df, strategy, **options):
    if options.get("method"):
        within = options.pop("partition_by", None) or []
        options["partition_by"] = [*([within] if isinstance(within, str) else within), BODY]
    return nulls.handle_nulls(df, strategy, **options)


def _template(df, template_path=None, template=None):
    return plans.template_rows(df, template_path, template, keep=[BODY])


def _schema_gate(df, target_column, schema_path=None, schema=None):
    bad = validate_json.schema_violations(df, target_column, plans.loaded_schema(schema_path, schema))
    return grouped_gates.row_failures(bad, "JSON Schema validation failed", [BODY])


def _ngsi_gate(df, ngsi_version="ld", stop_on_first_error=None, line_column="value"):
    bad = validate_json.ngsi_violations(df, line_column, ngsi_version)
    return grouped_gates.row_failures(bad, "NGSI validation failed", [BODY], 1 if stop_on_first_error else 20)


#: Steps that change rows, and gates, each within bodies.
STEPS: dict[str, Callable] = {
    "with_duckdb": plans.STEPS["with_duckdb"],
    "with_spark": plans.STEPS["with_spark"],
    "with_jinja2": _template,
    "duplicate_remover": _dedupe,
    "null_handler": _nulls,
    "receive_http": plans.STEPS["receive_http"],
}
GATES: dict[str, Callable] = {
    "data_quality": lambda df, rules: grouped_gates.quality_failures(df, rules, [BODY]),
    "business_rules": lambda df, rules: grouped_gates.business_failures(df, rules, [BODY]),
    "json_schema": _schema_gate,
    "ngsi_validator": _ngsi_gate,
}


@dataclass(frozen=True)
class Judged:
    """Rows of the bodies that passed, and ``(_body, step, message)`` of the others, stored."""

    rows: DataFrame
    refused: DataFrame


def _without(df: DataFrame, refused: DataFrame, number: int) -> DataFrame:
    if not number:
        return df
    bodies = refused.select(BODY)
    return df.join(F.broadcast(bodies) if number <= FEW else bodies, BODY, "left_anti")


def run_bodies(df: DataFrame, steps: list[dict], own: dict[str, Callable] | None = None) -> Judged:
    """Run steps on rows with the column ``_body``, as if each body were a table of its own.

    Duplicates, gaps carried on, rules and validations are those within a body. SQL text and steps of
    one's own see the rows of all bodies and have to keep ``_body`` (``GROUP BY _body, ...``). A body
    without rows is not judged. Every gate costs one pass over the rows before it.
    """
    spark, refused = df.sparkSession, []

    def judge(rows: DataFrame, name: str, failures: DataFrame) -> DataFrame:
        path = scratch_path(spark, "refused")
        failures.select(BODY, F.lit(name).alias("step"), "message").write.parquet(path)
        found = spark.read.schema(_REFUSED).parquet(path)
        refused.append(found)
        return _without(rows, found, found.count())

    if MALFORMED in df.columns:
        failures = grouped_gates.malformed_failures(df, MALFORMED, [BODY])
        df = judge(df, "read", failures).drop(MALFORMED)
    for step in steps:
        plugin, params = step["plugin"], dict(step.get("params") or {})
        arguments = {k: v for k, v in params.items() if k not in plans.PATHS}
        if plugin in GATES:
            df = judge(df, plugin, GATES[plugin](df, **arguments))
            continue
        function = plugin if callable(plugin) else {**STEPS, **(own or {})}.get(plugin)
        if function is None:
            raise ValueError(f"Step '{plugin}' does not work on single bodies of a batch.")
        df = function(df, **arguments)
        if BODY not in df.columns:
            raise ValueError(f"Step '{plugin}' has to keep the column '{BODY}'.")
    nobody = spark.createDataFrame([], _REFUSED)
    return Judged(df, reduce(DataFrame.unionByName, refused, nobody))


def ingest_bodies(
    stream: DataFrame,
    steps: list[dict],
    target: str,
    checkpoint: str,
    own: dict[str, Callable] | None = None,
    available_now: bool = True,
    interval: str | None = None,
) -> StreamingQuery:
    """Run steps on each micro-batch of a landing stream, and judge every landed file by itself.

    Of batch *n*, rows of good bodies go to ``target/batch=n``, the landed rows of refused ones with
    ``message`` to ``target.rejected/batch=n``, and ``(_body, status, step, message, rows_in, rows_out)``,
    a row per body, to ``target.reports/batch=n``. All three are replaced if the batch runs again. Read
    the stream with ``on_malformed="mark"`` so that malformed records refuse their body as well.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            judged = run_bodies(kept, steps, own)
            path = f"{target}/batch={batch_id}"
            judged.rows.write.mode("overwrite").parquet(path)
            written = spark.read.schema(judged.rows.schema).parquet(path)
            rejected = kept.drop(MALFORMED).join(judged.refused.select(BODY, "message"), BODY)
            rejected.write.mode("overwrite").parquet(f"{target}.rejected/batch={batch_id}")
            rows_out = written.groupBy(BODY).agg(F.count("*").alias("rows_out"))
            report = (
                kept.groupBy(BODY).agg(F.count("*").alias("rows_in"))
                .join(judged.refused, BODY, "left").join(rows_out, BODY, "left")
                .select(
                    BODY, F.when(F.col("step").isNull(), "ok").otherwise("error").alias("status"), "step",
                    "message", "rows_in", F.coalesce("rows_out", F.lit(0)).cast("long").alias("rows_out"),
                )
            )
            report.write.mode("overwrite").parquet(f"{target}.reports/batch={batch_id}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return start(writer, available_now, interval)
