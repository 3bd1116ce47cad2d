"""Whole files as rows, and catalogs of files."""

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.formats import format_of_path
from tidegate.functions.missing import column
from tidegate.scratch import scratch_path


_FILE_ROW = "path string, modificationTime timestamp, length long, content binary"


def read_files(
    spark: SparkSession, path: str, glob: str | None = None, with_empty: bool = True
) -> DataFrame:
    """Files below ``path`` as ``(path, modificationTime, length, content)``.

    A column that is not selected is not read: without ``content`` only the listing runs. Spark's
    own reader leaves out empty files; they are listed apart, unless ``with_empty`` is off.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.unionByName(_empty_files(spark, path, glob)) if with_empty else files


def _empty_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """The empty files below ``path``, as rows of files."""
    found = list_files(spark, path, glob).filter("length = 0")
    return found.select("path", F.col("modified").alias("modificationTime"), "length", F.lit(b"").alias("content"))


_LISTED = "path string, length long, modified timestamp, folder boolean"


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length, modified)`` of the visible files below ``path``, listed level by level.

    The folders of a level are dealt over tasks, each of which lists the folders it gets; what they
    hold is written to the checkpoint folder, and the folders among it are the next level. So a deep
    tree, a wide one and a lopsided one are all listed by many tasks, and neither names nor files pass
    through the driver. ``glob`` is for names of files. Hidden files and folders (``_``, ``.``) are
    left out, as by Spark's readers.
    """
    if any(c in path for c in "*?[{"):
        raise ValueError("Give a folder and glob=, or pass with_empty=False to match paths.")
    system, root = file_system(path)
    prefix = path[: path.rindex(root.strip("/"))].removesuffix("/") if "://" in path else "file:"
    prefix = "file:" if prefix in ("file:", "file://") else prefix
    if not root.startswith("/"):
        prefix += "/"
    names = ["path", "length", "modified", "folder"]

    def rows(infos: list[fs.FileInfo]) -> pa.RecordBatch:
        kept = [
            i for i in infos
            if _is_visible(i) and (not i.is_file or not glob or fnmatch.fnmatchcase(i.base_name, glob))
        ]
        columns = (
            pa.array([prefix + i.path if i.is_file else i.path for i in kept], pa.string()),
            pa.array([i.size if i.is_file else 0 for i in kept], pa.int64()),
            pa.array([i.mtime for i in kept], pa.timestamp("us", "UTC")),
            pa.array([not i.is_file for i in kept], pa.bool_()),
        )
        return pa.RecordBatch.from_arrays(list(columns), names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = file_system(path)[0]
            for folder in batch["path"].to_pylist():
                infos = own.get_file_info(fs.FileSelector(folder))
                for at in range(0, len(infos), 10_000):
                    yield rows(infos[at : at + 10_000])

    whole = system.get_file_info(root)
    if whole.is_file:
        one = [(prefix + whole.path, whole.size, whole.mtime)] if _is_visible(whole) else []
        one = one if not glob or fnmatch.fnmatchcase(whole.base_name, glob) else []
        return spark.createDataFrame(one, _LISTED.replace(", folder boolean", ""))
    store = scratch_path(spark, "listing")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, level = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        target = f"{store}/level={level:05d}"
        spread = folders.repartition(min(tasks, max(1, folders.count())), "path")
        spread.mapInArrow(listed, _LISTED).write.parquet(target)
        folders = spark.read.schema(_LISTED).parquet(target).filter("folder").select("path")
        if folders.isEmpty():
            break
        level += 1
    return spark.read.schema(_LISTED).parquet(f"{store}/level=*").filter("NOT folder").select(*names[:3])


def _is_visible(info: fs.FileInfo) -> bool:
    """Whether Spark sees the file or folder."""
    return not info.base_name.startswith(("_", "."))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def file_catalog(
    spark: SparkSession, path: str, glob: str | None = None, with_empty: bool = True
) -> DataFrame:
    """Files below ``path`` as ``(path, length, modified, format)``, without their content.

    With empty files the tasks list the folders (:func:`list_files`). Else Spark does, on the driver,
    which also takes patterns and stores that only Spark can read.
    """
    if with_empty:
        files = list_files(spark, path, glob)
    else:
        files = read_files(spark, path, glob, False).withColumnRenamed("modificationTime", "modified")
    return files.select("path", "length", "modified", format_of_path(F.col("path")).alias("format"))


def path_info(path: str) -> Row | None:
    """``(path, is_dir, length, modified)`` of one path, or None if there is nothing."""
    system, name = file_system(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        return None
    is_dir = info.type == fs.FileType.Directory
    return Row(path=path, is_dir=is_dir, length=0 if is_dir else info.size, modified=info.mtime)


def read_heads(catalog: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """The first bytes of each file of a catalog, as ``(path, head, cut)``; the rest is not read.

    ``cut`` says that the file goes on. The files are spread over ``tasks`` tasks (as many as
    there are shuffle partitions by default).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch["path"].to_pylist()
            for start in range(0, len(paths), 1000):
                part = paths[start : start + 1000]
                heads = [_head(path, size + 1) for path in part]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array(part, pa.string()),
                        "head": pa.array([head[:size] for head in heads], pa.binary()),
                        "cut": pa.array([len(head) > size for head in heads]),
                    }
                )

    # A fixed number: by their size, the paths would all be joined into one task.
    tasks = tasks or int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = catalog.select("path").repartition(tasks, "path")
    return spread.mapInArrow(read, "path string, head binary, cut boolean")


def _head(path: str, size: int) -> bytes:
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        return file.read(size)


def leaves_folder(path: str) -> bool:
    """Whether a relative path points outside of the folder it is joined to."""
    return path.startswith("/") or ".." in path.split("/")


def write_files(df: DataFrame, target: str, path: str = "path", content: str = "content") -> Row:
    """Write one file per row below ``target``, from the tasks; returns ``(files, bytes)``.

    ``path`` holds paths relative to ``target``, each at most once. A task that is run again
    writes the same files again.
    """
    rows = df.select(column(path).alias("path"), column(content).cast("binary").alias("content"))
    twice = rows.groupBy("path").count().where("count > 1").select("path").limit(5).collect()
    if twice:
        raise ValueError(f"Several rows have the same path, such as: {[row.path for row in twice]}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(target)
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                if not name:
                    raise ValueError("A row has no path.")
                if leaves_folder(name):
                    raise ValueError(f"Path leaves the target folder: {name}")
                full = f"{folder.rstrip('/')}/{name}"
                system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                # The bytes as they are, also under names such as *.gz.
                with system.open_output_stream(full, compression=None) as stream:
                    stream.write(data.as_buffer() or b"")
            sizes = pc.binary_length(batch["content"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([sizes], ["bytes"])

    written = rows.mapInArrow(write, "bytes long")
    return written.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).first()
