"""Tables in files: CSV, Parquet, JSON and JSON Lines."""

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.formats import format_from_name, format_from_path
from tidegate.functions.missing import ORDER_COLUMN, column, data_columns, nan_to_null, quoted
from tidegate.sources.files import read_heads
from tidegate.sources.records import (
    Grammar, csv_grammar, json_grammar, lines_grammar, opens_any_cell, read_records,
)

TABLE_FORMATS = ("csv", "parquet", "json", "jsonl")

# Texts that stand for a missing value in a CSV cell.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Python codec name -> Java charset name, where the two differ.
JAVA_CHARSETS = {
    "cp932": "windows-31j",
    "utf-8-sig": "UTF-8",
    "utf-16": "UTF-16",
    "utf-32": "UTF-32",
    "iso8859-1": "ISO-8859-1",
    "ascii": "US-ASCII",
    "euc_jp": "EUC-JP",
    "euc_kr": "EUC-KR",
    "shift_jis": "Shift_JIS",
    "iso2022_jp": "ISO-2022-JP",
}

# Charsets Spark reads without the legacy switch for other Java charsets.
_SPARK_CHARSETS = {
    "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "iso-8859-1", "us-ascii",
}

_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_BOOLEAN_TEXT = {"true": ("True", "TRUE", "true"), "false": ("False", "FALSE", "false")}
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def java_charset(spark: SparkSession, encoding: str) -> str:
    """The Java name of a Python text encoding."""
    name = codecs.lookup(encoding).name
    charset = JAVA_CHARSETS.get(name, name)
    legacy = spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "true"
    if charset.lower() not in _SPARK_CHARSETS and not legacy:
        raise ValueError(
            f"To use '{encoding}' here, set spark.sql.legacy.javaCharsets=true on the session."
        )
    return charset


def table_format(path: str, fmt: str | None) -> str:
    chosen = format_from_name(fmt) if fmt else format_from_path(path)
    if chosen not in TABLE_FORMATS:
        raise ValueError(f"Tables in format '{chosen}' are not supported; use one of {TABLE_FORMATS}.")
    return chosen


# Options that say which files are read, and those that records can be parsed with one by one.
_FILE_OPTIONS = {"pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter"}
_CELL_OPTIONS = {"sep", "delimiter", "nullValue", "emptyValue"}
_CSV = {"quote": '"', "escape": '"'}


def bytewise(encoding: str) -> str | None:
    """The charset's name if no byte below 0x40 is part of another character than its own.

    So line ends, quotes and separators can be found before the text is decoded.
    """
    name = codecs.lookup(encoding).name
    if name.startswith(("utf-16", "utf-32", "utf-7", "iso2022", "hz")):
        return None
    ascii_bytes = bytes(range(128))
    same = ascii_bytes.decode(name, "replace") == ascii_bytes.decode("ascii")
    return name.replace("utf-8-sig", "utf-8") if same else None


def _is_own(charset: str) -> bool:
    """Whether Spark reads the charset without the legacy switch for other Java charsets."""
    return JAVA_CHARSETS.get(charset, charset).lower() in _SPARK_CHARSETS


def _file_options(options: dict) -> dict:
    return {k: v for k, v in options.items() if k in _FILE_OPTIONS}


def _order_of(records: DataFrame) -> Column:
    """The place of a record as :func:`with_file_order` gives it for rows."""
    return F.struct("file", "block", "row").alias(ORDER_COLUMN)


def _csv_records(spark, path, charset, sep, options) -> DataFrame | None:
    """The cells of a CSV file as texts and the order of its rows, read in splits.

    The first record of each file is its header, and has to be the same in all of them.
    """
    files = _file_options(options)
    records = read_records(spark, path, csv_grammar(sep), charset, **files)
    first = (F.col("block") == 0) & (F.col("row") == 0)
    header = records.filter(first).select("record").first()
    if header is None:
        return None
    cells = {k: v for k, v in options.items() if k in _CELL_OPTIONS} | _CSV
    names = spark.read.options(header=True, **cells).csv(spark.sparkContext.parallelize([header.record], 1)).columns
    schema = ", ".join(f"{quoted(name)} string" for name in names)
    parsed = F.from_csv("record", schema, cells | {"mode": "FAILFAST"}).alias("cells")
    other = F.concat(F.col("file"), F.lit(" has another header than the first file."))
    is_row = F.when(~first, True).otherwise(
        F.when(F.col("record") == header.record, False).otherwise(F.raise_error(other).cast("boolean"))
    )
    rows = records.filter(is_row).select(parsed, _order_of(records))
    return rows.select("cells.*", ORDER_COLUMN)


def _missing_to_null(name: str) -> Column:
    # Columns that come from the path may have other types.
    text = column(name).cast("string")
    return F.when(~text.isin(*CSV_MISSING), text)


def _infer_csv_types(texts: DataFrame) -> dict[str, str]:
    """Type of each all-text column: bigint, double, boolean or string, from one scan."""
    booleans = [text for texts_ in _BOOLEAN_TEXT.values() for text in texts_]
    checks = []
    for i, name in enumerate(texts.columns):
        cell = column(name)
        integer = F.when(cell.isNotNull(), cell.rlike(_INTEGER) & cell.try_cast("bigint").isNotNull())
        checks += [
            F.count(cell).alias(f"n{i}"),
            F.bool_and(integer).alias(f"bigint{i}"),
            F.bool_and(cell.rlike(_NUMBER)).alias(f"double{i}"),
            F.bool_and(cell.isin(*booleans)).alias(f"boolean{i}"),
        ]
    if not checks:
        return {}
    found = texts.agg(*checks).first()
    types = {}
    for i, name in enumerate(texts.columns):
        fits = [t for t in ("bigint", "double", "boolean") if found[f"{t}{i}"]]
        # A column without any value is a column of missing numbers.
        types[name] = "double" if found[f"n{i}"] == 0 else (fits or ["string"])[0]
    return types


def _typed(name: str, dtype: str | T.DataType) -> Column:
    return _as_type(column(name), dtype).alias(name)


def _as_type(cell: Column, dtype: str | T.DataType, strict: bool = True) -> Column:
    kind = dtype.simpleString() if isinstance(dtype, T.DataType) else dtype
    if kind == "boolean":
        cell = F.when(cell.isin(*_BOOLEAN_TEXT["true"]), True).when(
            cell.isin(*_BOOLEAN_TEXT["false"]), False
        )
    return cell.cast(dtype) if strict else cell.try_cast(dtype)


def csv_cell(name: str, dtype: str | T.DataType, strict: bool = True) -> Column:
    """A CSV cell, read as text, in its column's type; null where it is missing.

    One that is not of the type fails the job, or is null as well if not ``strict``.
    """
    return _as_type(_missing_to_null(name), dtype, strict)


def csv_cell_unread(name: str, dtype: str | T.DataType) -> Column:
    """Whether a CSV cell, read as text, holds something that is not of its column's type."""
    return _missing_to_null(name).isNotNull() & csv_cell(name, dtype, strict=False).isNull()


def _read_csv(spark, path, schema, encoding, multiline, row_order, options) -> DataFrame:
    sep, charset = options.get("sep", options.get("delimiter", ",")), bytewise(encoding)
    files = _file_options(options)
    usual = charset and len(sep) == 1 and set(options) <= _FILE_OPTIONS | _CELL_OPTIONS
    if multiline is None:
        multiline = opens_any_cell(spark, path, sep, files) if usual else True
    # Partition columns come from the path, which records know nothing of.
    apart = usual and (multiline or not _is_own(charset)) and spark.read.options(**files).text(path).columns == ["value"]
    ordered = _csv_records(spark, path, charset, sep, options) if apart else None
    if ordered is not None:
        raw = ordered.drop(ORDER_COLUMN)
    else:
        reader = spark.read.options(
            header=True, **_CSV, encoding=java_charset(spark, encoding), multiLine=multiline,
            enforceSchema=False, mode="FAILFAST",
        ).options(**options)
        raw = reader.csv(path)
        ordered = with_file_order(raw) if row_order else raw
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = {field.name: field.dataType for field in schema.fields}
        if list(types) != raw.columns:
            raise ValueError(f"{path} has columns {raw.columns}, the schema has {list(types)}.")
    texts = raw.select(*[_missing_to_null(name).alias(name) for name in raw.columns])
    if schema is None:
        types = _infer_csv_types(texts)
    keep = [ORDER_COLUMN] if row_order else []
    texts = ordered.select(*[_missing_to_null(name).alias(name) for name in raw.columns], *keep)
    return texts.select(*[_typed(name, types[name]) for name in raw.columns], *keep)


def with_file_order(scan: DataFrame) -> DataFrame:
    """Add the position of each row: file, block within the file, row within the block.

    Must follow the scan directly.
    """
    return scan.withColumn(
        ORDER_COLUMN,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for steps that cost much per row, where a small input has few splits.

    For a table as it was read. One with at least as many splits as there are cores stays as it
    is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: str | T.StructType | None = None,
    encoding: str = "utf-8",
    multiline: bool | None = None,
    row_order: bool = False,
    nan_as_null: bool = False,
    **options,
) -> DataFrame:
    """Read a table; its format follows from the extension unless ``fmt`` is given.

    CSV has a header line, ``""`` as the escaped quote, and the usual texts for missing values;
    files are read in splits, also if quoted cells hold line ends, in UTF-8 and in charsets in which
    ASCII bytes stand for themselves. With ``schema`` no scan is spent on types. A row with more or fewer cells than the header
    fails the job. ``.jsonl`` has one record per line; a ``.json`` file whose first character is
    ``[`` is one document, an array of records, any other one has a record per line. To tell them
    apart the first bytes of all files are read, unless ``multiline`` says which they are. Documents
    in UTF-8 are read in splits as well. ``row_order`` adds the hidden column that ``keep="first"``,
    ``ffill`` and the like use as the order of rows.
    """
    chosen = table_format(path, fmt)
    if chosen == "csv":
        df = _read_csv(spark, path, schema, encoding, multiline, row_order, options)
        return nan_to_null(df) if nan_as_null else df
    if chosen == "parquet":
        reader = spark.read.options(**options)
        df = (reader if schema is None else reader.schema(schema)).parquet(path)
        df = with_file_order(df) if row_order else df
    else:
        if multiline is None and chosen == "json":
            documents, others = _json_documents(spark, path)
        else:
            documents, others = ([path], []) if multiline else ([], [path])
        parts = [
            _read_json(spark, paths, schema, whole, row_order, encoding, options)
            for paths, whole in ((documents, True), (others, False))
            if paths
        ]
        df = parts[0]
        if len(parts) > 1:
            df = df.unionByName(parts[1], allowMissingColumns=True)
    return nan_to_null(df) if nan_as_null else df


def _json_documents(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The paths of array documents, and of files with a record per line, by their first bytes.

    Where all files are of one kind, their common path stands for them. Else the files are
    named one by one, which is what Spark's own listing of them holds as well.
    """
    catalog = spark.read.format("binaryFile").load(path).select("path", "length")
    # The last character may be cut, and other charsets are not UTF-8.
    heads = read_heads(catalog, 4096).select("path", F.make_valid_utf8(F.col("head").cast("string")).alias("text"))
    text = F.ltrim(F.regexp_replace("text", "^[\ufeff\ufffd\\s\\x00]+", ""))
    found = heads.select("path", text.startswith("[").alias("document"))
    kinds = dict(found.groupBy("document").count().collect())
    if len(kinds) < 2:
        return ([path], []) if True in kinds else ([], [path])
    files = found.collect()
    return [f for f, document in files if document], [f for f, document in files if not document]


def _read_json(spark, paths, schema, whole_document, row_order, encoding, options) -> DataFrame:
    charset = bytewise(encoding)
    cut = None
    if whole_document and charset == "utf-8":
        cut = _json_records(spark, paths, json_grammar(), charset, schema, options)
    elif charset not in (None, "utf-8") and not whole_document:
        cut = _json_records(spark, paths, lines_grammar(), charset, schema, options)
    if cut is not None:
        return cut if row_order else cut.drop(ORDER_COLUMN)
    reader = spark.read.options(**options, encoding=java_charset(spark, encoding))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(multiLine=whole_document, mode="FAILFAST").json(paths)
    if schema is None and not whole_document:
        df = _in_written_order(df, paths)
    return with_file_order(df) if row_order else df


def _json_records(
    spark: SparkSession, paths: list[str], grammar: Grammar, charset: str, schema, options: dict
) -> DataFrame | None:
    """JSON records of some form and their order, read in splits; None where that can't be done."""
    files = _file_options(options)
    if spark.read.options(**files).text(paths).columns != ["value"]:
        return None
    records = read_records(spark, paths, grammar, charset, **files)
    options = {k: v for k, v in options.items() if k not in _FILE_OPTIONS}
    if schema is None:
        # Types are inferred by Spark's reader, which takes texts from an RDD only.
        texts = records.select("record").rdd.map(lambda row: row.record)
        schema = spark.read.options(**options, mode="FAILFAST").json(texts).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not schema.fields:
        return None
    parsed = F.from_json("record", schema, options | {"mode": "FAILFAST"}).alias("cells")
    return records.select(parsed, _order_of(records)).select("cells.*", ORDER_COLUMN)


def _in_written_order(df: DataFrame, path: str | list[str]) -> DataFrame:
    """Columns in the order of the first record; inference alone sorts them by name."""
    first = df.sparkSession.read.text(path).limit(1).select(F.json_object_keys("value")).first()
    written = [name for name in (first[0] if first else None) or [] if name in df.columns]
    rest = [name for name in df.columns if name not in written]
    return df.select(*map(column, dict.fromkeys(written + rest)))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "overwrite",
    encoding: str = "utf-8",
    partition_by: list[str] | None = None,
    **options,
) -> None:
    """Write a table as a folder of files; ``.json`` and ``.jsonl`` both hold one record per line."""
    chosen = table_format(path, fmt)
    writer = df.select(*[column(name) for name in data_columns(df)]).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if chosen == "parquet":
        writer.options(**options).parquet(path)
        return
    # Timestamps keep their microseconds.
    writer = writer.options(
        timestampNTZFormat=_MICROS,
        timestampFormat=_MICROS + "XXX",
        encoding=java_charset(df.sparkSession, encoding),
    )
    if chosen == "csv":
        writer.options(header=True, quote='"', escape='"', **options).csv(path)
    else:
        writer.options(ignoreNullFields=False, **options).json(path)


def convert(
    spark: SparkSession,
    source: str,
    target: str,
    source_format: str | None = None,
    target_format: str | None = None,
    **read_options,
) -> None:
    """Read a table in one format and write it in another."""
    write_table(read_table(spark, source, source_format, **read_options), target, target_format)
