"""Streams of landed files, run through the same steps as tables."""

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegate.errors import DataQualityError, DeliveryError
from tidegate.functions.missing import column
from tidegate.plans.steps import Step, run_steps
from tidegate.sources.tables import csv_cell, csv_cell_unread, table_format

BODY = "_body"
#: Holds the text of a record that could not be read.
MALFORMED = "_malformed"


def read_landing(
    spark: SparkSession,
    folder: str,
    fmt: str,
    schema: str | T.StructType,
    files_per_batch: int | None = None,
    max_bytes_per_batch: int | None = None,
    on_malformed: str = "fail",
    **options,
) -> DataFrame:
    """A stream of the files that arrive in a folder; ``_body`` names the file of each row.

    A cell that is not of its column's type, a row of more or fewer cells than columns, and a
    malformed JSON record fail the stream, as they fail the reading of a table; with
    ``on_malformed="mark"`` they are rows whose column ``_malformed`` says what is wrong. A ``.json``
    file is one document here; name the format ``jsonl`` for records by line.
    """
    if on_malformed not in ("fail", "mark"):
        raise ValueError(f"on_malformed must be 'fail' or 'mark', not {on_malformed!r}.")
    mark = on_malformed == "mark"
    chosen = table_format(folder, fmt)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # CSV cells are read as texts: one that is not of its column's type fails the stream.
    cells = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    read = cells if chosen == "csv" else schema
    if mark and chosen != "parquet":
        read = T.StructType([*read.fields, T.StructField(MALFORMED, T.StringType())])
    reader = spark.readStream.schema(read)
    reader = reader.option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    elif max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
    if chosen == "csv":
        reader = reader.options(header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")
    elif chosen == "json":
        reader = reader.options(multiLine=True, mode="FAILFAST")
    elif chosen == "jsonl":
        reader = reader.options(mode="FAILFAST")
    if mark and chosen != "parquet":
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)
    source = "json" if chosen == "jsonl" else chosen
    rows = reader.options(**options).format(source).load(folder)
    if chosen == "csv":
        bad = [F.concat(F.lit(f"{f.name}: "), column(f.name)) for f in schema.fields]
        unread = [csv_cell_unread(f.name, f.dataType) for f in schema.fields]
        marks = F.concat_ws(", ", *(F.when(is_bad, text) for is_bad, text in zip(unread, bad)))
        if mark:
            rows = rows.withColumn(MALFORMED, F.coalesce(MALFORMED, F.nullif(marks, F.lit(""))))
        rows = rows.withColumns({f.name: csv_cell(f.name, f.dataType, strict=not mark) for f in schema.fields})
    return rows.withColumn(BODY, F.col("_metadata.file_path"))


def rejected(error: Exception) -> bool:
    """Whether a gate raised the error, in the driver or inside of a plan."""
    if isinstance(error, (DataQualityError, DeliveryError)):
        return True
    return isinstance(error, PySparkException) and "USER_RAISED_EXCEPTION" in str(error)


def start(writer, available_now: bool, interval: str | None) -> StreamingQuery:
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval or "10 seconds").start()


def ingest(
    stream: DataFrame,
    steps: list[dict],
    target: str,
    checkpoint: str,
    fmt: str = "parquet",
    own: dict[str, Step] | None = None,
    available_now: bool = True,
    interval: str | None = None,
) -> StreamingQuery:
    """Run row-wise steps on a stream and append to ``target``, exactly once per landed row.

    Suits steps without order or grouping (SQL projections and filters, fills, rendering); the
    others need whole batches, see :func:`ingest_batches`.
    """
    output = run_steps(stream.sparkSession, steps, stream, own, write="none").result
    writer = output.writeStream.format("json" if fmt == "jsonl" else fmt)
    return start(
        writer.option("path", target).option("checkpointLocation", checkpoint), available_now, interval
    )


def ingest_batches(
    stream: DataFrame,
    steps: list[dict],
    target: str,
    checkpoint: str,
    own: dict[str, Step] | None = None,
    on_error: str = "fail",
    available_now: bool = True,
    interval: str | None = None,
    report: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Run any steps on each micro-batch.

    Batch *n* is written to ``target/batch=n`` and its report to ``target.reports/batch=n``,
    both replaced if the batch is run again. With ``on_error="skip"`` a batch that a gate
    rejects is reported with status ``error`` and the stream goes on; any other error fails it. To judge each
    landed file of a batch by itself, see :func:`tidegate.streaming.bodies.ingest_bodies`.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error!r}.")

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        path = f"{target}/batch={batch_id}"
        try:
            status, message = "ok", None
            try:
                run_steps(spark, steps, kept, own, write="none").result.write.mode(
                    "overwrite"
                ).parquet(path)
            except Exception as error:
                if on_error == "fail" or not rejected(error):
                    raise
                status, message = "error", str(error)
            counts = kept.agg(F.count("*").alias("rows_in"), F.count_distinct(BODY).alias("bodies"))
            if status == "ok":
                rows_out = spark.read.parquet(path).count()
            else:
                rows_out = 0
            summary = counts.select(
                F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"),
                "bodies", "rows_in", F.lit(rows_out).cast("long").alias("rows_out"),
            )
            summary = report(summary, batch_id) if report else summary
            summary.write.mode("overwrite").parquet(f"{target}.reports/batch={batch_id}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return start(writer, available_now, interval)
