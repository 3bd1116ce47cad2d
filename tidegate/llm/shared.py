"""Small helpers that several operators of this package use."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.scratch import scratch_path

#: Stands for a null doc_id within operators.
NO_ID = -(2**63)


#: Removes the shuffle files of a query when it ends, not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table of the shared checkpoint folder and read again: cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
            found = jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


#: Tables of at most so many narrow rows (some 30 MB) are broadcast.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A stored table of few columns, marked for a broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch, empty for null."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""


def batches(
    schema: pa.Schema, parts: Iterator[tuple], size: int = 1 << 16
) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` rows out of tuples of equally long numpy arrays."""
    held: list[tuple] = []
    rows = 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            rows += len(part[0])
        if rows >= size:
            yield _joined(schema, held)
            held, rows = [], 0
    if held:
        yield _joined(schema, held)


def _joined(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    columns = (np.concatenate(column) for column in zip(*held))
    arrays = [pa.array(column, field.type) for column, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    """One list of longs per array."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat), pa.int64()))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
