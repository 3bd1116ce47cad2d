import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.functions.formats import (
    FORMAT_BY_EXTENSION, SUFFIX_BY_CONTENT_TYPE, format_from_name, format_from_path, format_of_content_type, format_of_path,
    suffix_of_content_type,
)

# Known extensions in any folder and letter case; the rest shows how a path is cut.
PATHS = {
    path: name
    for i, (extension, name) in enumerate(sorted(FORMAT_BY_EXTENSION.items()))
    for path in (f"s3a://landing/day={i}/part-{i}.{extension}", f"{extension}.d/v1.{i}.{extension.title()}")
} | {
    "meters/2024.tar.gz": "tar",
    "meters/2024.TAR.Xz": "tar",
    "meters/2024.tar.zst": "unknown",
    "readings.parquet.crc": "unknown",
    "readings.csv/": "csv",
    "readings.csv/_SUCCESS": "unknown",
    "archive.zip/readme": "unknown",
    "/.json": "unknown",
    "trailing.": "unknown",
}


def test_format_from_path():
    assert {path: format_from_path(path) for path in PATHS} == PATHS


def test_format_of_path_column(spark):
    df = spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string")
    found = dict(rows(df.select("path", format_of_path(F.col("path")))))
    assert found == {**PATHS, None: None}


def test_format_from_name():
    assert format_from_name("GTFS-RT") == "gtfs-rt"
    with pytest.raises(ValueError):
        format_from_name("docx")


def test_content_types(spark):
    expected = {None: ".bin", "": ".bin", "text": ".bin", "image/png": ".bin", "text/csvx": ".bin"}
    for media, suffix in SUFFIX_BY_CONTENT_TYPE.items():
        expected |= {
            media.upper(): suffix,
            f"  {media} ;q=1; charset=latin-1": suffix,
            f"{media};": suffix,
        }
    df = spark.createDataFrame([(t,) for t in expected], "t string")
    found = dict(rows(df.select("t", suffix_of_content_type(F.col("t")))))
    assert found == expected
    formats = dict(rows(df.select("t", format_of_content_type(F.col("t")))))
    assert formats["TEXT/PLAIN"] == "text" and formats[None] == "binary"

