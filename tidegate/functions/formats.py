"""File formats by name, by path and by content type."""

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The format names.
FORMATS = (
    "csv", "parquet", "excel", "json", "jsonl", "xml", "shapefile", "geojson",
    "gtfs", "gtfs-rt", "zip", "tar", "text", "binary", "unknown",
)

# File extension -> format.
FORMAT_BY_EXTENSION = {
    "csv": "csv",
    "parquet": "parquet",
    "xls": "excel",
    "xlsx": "excel",
    "json": "json",
    "jsonl": "jsonl",
    "xml": "xml",
    "shp": "shapefile",
    "geojson": "geojson",
    "txt": "text",
    "zip": "zip",
    "tar": "tar",
    "pb": "gtfs-rt",
}

# Compression suffixes that may wrap a tar file.
TAR_COMPRESSIONS = ("gz", "bz2", "xz")

# Media type -> file suffix.
SUFFIX_BY_CONTENT_TYPE = {
    "text/csv": ".csv",
    "application/json": ".json",
    "application/parquet": ".parquet",
    "application/octet-stream": ".bin",
    "text/plain": ".txt",
}


def format_from_name(name: str) -> str:
    """The format with this name, in any letter case."""
    if name.lower() not in FORMATS:
        raise ValueError(f"'{name}' is not a supported format; use one of {FORMATS}.")
    return name.lower()


def format_from_path(path: str | os.PathLike) -> str:
    """The format of one path, judged by its extension."""
    base = os.fspath(path).rstrip("/").rsplit("/", 1)[-1].lower()
    if re.search(rf"[^.].*\.tar\.({'|'.join(TAR_COMPRESSIONS)})$", base):
        return "tar"
    extension = re.search(r"[^.].*\.([^.]*)$", base)
    return FORMAT_BY_EXTENSION.get(extension.group(1), "unknown") if extension else "unknown"


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(text) for pair in table.items() for text in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def format_of_path(path: Column) -> Column:
    """The format of each path in a column, judged by its extension."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    compressed_tar = base.rlike(rf"[^.].*\.tar\.({'|'.join(TAR_COMPRESSIONS)})$")
    extension = F.regexp_extract(base, r"[^.].*\.([^.]*)$", 1)
    return (
        F.when(path.isNull(), F.lit(None).cast("string"))
        .when(compressed_tar, F.lit("tar"))
        .otherwise(_lookup(extension, FORMAT_BY_EXTENSION, "unknown"))
    )


def suffix_of_content_type(content_type: Column) -> Column:
    """The file suffix for each content type; parameters and letter case are ignored."""
    media_type = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return _lookup(media_type, SUFFIX_BY_CONTENT_TYPE, ".bin")


def format_of_content_type(content_type: Column) -> Column:
    """The format in which a body with this content type is stored."""
    suffix = suffix_of_content_type(content_type)
    known = format_of_path(F.concat(F.lit("body"), suffix))
    return F.when(suffix == ".bin", F.lit("binary")).otherwise(known)
