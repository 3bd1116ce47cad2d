"""Drops rows whose key occurs once, with one shuffle and without gathering any key in one task."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def repeated_only(df: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """The rows whose ``key`` (a long) occurs more than once, and a few others.

    Rows are range-partitioned by the key and the columns ``spread``, so that a frequent key covers
    several partitions, and sorted; each task drops keys that it sees once. The first and the last
    key of a partition may go on in the next one and always stay: at most two rows of each
    partition are kept that need not be. A task holds one batch of rows.
    """
    columns = df.columns
    ranged = df.repartitionByRange(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, *spread
    ).sortWithinPartitions(key)

    def several(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # the first key; the row that waits for its successor
        many = False  # whether that row's key is known to repeat or to be the first one
        for batch in found:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            if first is None:
                first = keys[0]
            same = keys[1:] == keys[:-1]
            keep = np.zeros(len(keys), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep |= keys == first
            if last is not None:
                if last.column(key)[0].as_py() == keys[0]:
                    keep[0] = many = True
                if many:
                    yield last
            many = bool(keep[-1])
            last = batch.slice(batch.num_rows - 1)
            keep[-1] = False
            if keep.any():
                yield batch.filter(pa.array(keep))
        if last is not None:
            yield last

    return ranged.select(*columns).mapInArrow(several, df.schema)
