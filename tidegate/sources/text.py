"""Text lines, and their numbers within a file."""

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.functions.missing import ORDER_COLUMN
from tidegate.functions.patterns import is_blank
from tidegate.sources.files import read_heads
from tidegate.sources.records import lines_grammar, read_records, wide_lines_grammar
from tidegate.sources.tables import bytewise, with_file_order


def read_lines(
    spark: SparkSession, path: str, keep_blank: bool = False, encoding: str = "utf-8", errors: str = "replace"
) -> DataFrame:
    """The lines below ``path`` as ``value``, with their order; blank lines are skipped.

    Files are read in splits in every ``encoding`` but those that change their meaning by escape
    sequences. Lines of UTF-16 are found by pairs of bytes; without an order in its name it is that of
    the mark of each file, which has to be the same in all files (little-endian without one). Bytes that
    are not valid become U+FFFD, or fail the job if ``errors`` is ``strict``.
    """
    charset = bytewise(encoding)
    if charset == "utf-8" and errors == "replace":
        lines = with_file_order(spark.read.text(path))
    else:
        if charset:
            grammar = lines_grammar()
        else:
            little = _is_little(spark, path, encoding)
            grammar, charset = wide_lines_grammar(little), "utf-16-le" if little else "utf-16-be"
        records = read_records(spark, path, grammar, charset, skip_blank=False, errors=errors)
        value = F.when(
            (F.col("block") == 0) & (F.col("row") == 0), F.ltrim(F.col("record"), F.lit("\ufeff"))
        ).otherwise(F.col("record"))
        lines = records.select(value.alias("value"), F.struct("file", "block", "row").alias(ORDER_COLUMN))
    return lines if keep_blank else lines.where(~is_blank(F.col("value")))


def _is_little(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether files of UTF-16 have the low byte first, by the name of the encoding or by their marks."""
    name = codecs.lookup(encoding).name
    if name in ("utf-16-le", "utf-16-be"):
        return name == "utf-16-le"
    if name != "utf-16":
        raise ValueError(f"Lines of '{encoding}' cannot be told apart by their bytes; decode whole files.")
    catalog = spark.read.format("binaryFile").load(path).select("path")
    big = read_heads(catalog, 2).select((F.col("head") == codecs.BOM_UTF16_BE).alias("big"))
    kinds = {row.big for row in big.distinct().collect()}
    if len(kinds) > 1:
        raise ValueError("The files have different byte orders; read them apart.")
    return True not in kinds


def number_lines(lines: DataFrame, all_lines: DataFrame, start: int = 1) -> DataFrame:
    """Add ``file`` and ``line_no`` (counted within the file) to some of the lines of a scan.

    ``lines`` is derived from ``all_lines``, the scan with its blank lines. One pass counts
    the lines of each file block; the blocks, not the lines, are then summed up per file. Should
    the two passes have cut a file differently, the job fails instead of misnumbering.
    """
    order = F.col(ORDER_COLUMN)
    blocks = all_lines.groupBy(order["file"].alias("_file"), order["block"].alias("_block")).agg(
        F.min(order["row"]).alias("_first"), F.count("*").alias("_count")
    )
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    placed = lines.withColumns({"_file": order["file"], "_block": order["block"]}).join(
        blocks, ["_file", "_block"], "left"
    )
    within = order["row"] - F.col("_first")
    known = within.between(0, F.col("_count") - 1)
    return placed.select(
        F.col("_file").alias("file"),
        F.when(F.coalesce(known, F.lit(False)), F.col("_offset") + within + start)
        .otherwise(F.raise_error(F.lit("File blocks changed between two scans; run again.")))
        .alias("line_no"),
        *[F.col(name) for name in lines.columns],
    )


def write_lines(df: DataFrame, text: str | Column, path: str, mode: str = "overwrite") -> None:
    """Write one text column as lines."""
    value = F.col(text) if isinstance(text, str) else text
    df.select(value.alias("value")).write.mode(mode).text(path)
