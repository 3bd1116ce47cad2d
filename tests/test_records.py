"""Records over lines and splits, against the csv and json modules and Spark's whole-file readers."""

import csv
import io
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.functions.missing import ORDER_COLUMN
from tidegate.sources.records import csv_grammar, json_grammar, opens_cell, read_records
from tidegate.sources.tables import read_table
from tidegate.sources.text import number_lines, read_lines

CELLS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


@pytest.fixture
def splits(spark):
    """Sets the size of splits for one test."""

    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield set_size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def cells(r, alphabet, most):
    return "".join(r.choice(alphabet) for _ in range(r.randint(0, most)))


@pytest.mark.parametrize("seed", range(6))
def test_csv_of_many_splits(spark, tmp_path, splits, seed):
    r = random.Random(seed)
    alphabet = ["a", "b", ",", '"', "\n", "\r\n", "é", " "]
    table = [[str(i), cells(r, alphabet, 14) + "x", "y" + cells(r, alphabet, 14)] for i in range(300)]
    table[150][1] = "a long cell\n" * r.choice([1, 300])
    buffer = io.StringIO(newline="")
    csv.writer(
        buffer, lineterminator=r.choice(["\n", "\r\n"]), quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL
    ).writerows([["i", "b", "c"], *table])
    encoding = ["utf-8", "latin-1"][seed % 2]
    path = tmp_path / "t.csv"
    path.write_bytes(buffer.getvalue().encode(encoding))
    splits(r.choice([900, 2000]))
    df = read_table(spark, str(path), schema="i long, b string, c string", encoding=encoding, row_order=True)
    assert df.rdd.getNumPartitions() > 3
    found = df.orderBy(ORDER_COLUMN).drop(ORDER_COLUMN).collect()
    assert [list(map(str, row)) for row in found] == table
    whole = spark.read.options(header=True, multiLine=True, encoding=encoding.replace("latin-1", "ISO-8859-1"), **CELLS).csv(str(path))
    assert rows(whole) == rows(df.drop(ORDER_COLUMN).withColumn("i", F.col("i").cast("string")))


LINES = [
    "a,b", 'a,"b', 'a,"b"', '"a""', '"a"""', 'a"b,c', '5","x', '"a"b"c,"d', '"a"b,"c', '"', '""', '"""', ',,"',
    ' "a', '"a,b""c""', '"a", "b', 'x,"y""z"",w', '"a"x"',
]


def test_quotes_that_open_a_cell(spark, tmp_path):
    """A record goes on where the reader of whole files finds no second one behind the line."""
    for i, line in enumerate(LINES):
        (tmp_path / f"{i}.csv").write_text(f"{line}\nmark")
    reader = spark.read.options(quote='"', escape='"', multiLine=True).schema("a string, b string, c string, d string")
    number = F.regexp_extract("_metadata.file_path", r"(\d+)\.csv$", 1).cast("int")
    read = reader.csv(str(tmp_path)).select(number.alias("i"), "*").collect()
    df = spark.createDataFrame([(line,) for line in LINES], "line string")
    found = [r.opens for r in df.select(opens_cell(F.col("line")).alias("opens")).collect()]
    assert found == [sum(r.i == i for r in read) == 1 for i in range(len(LINES))]
    assert sum(found) == 10


@pytest.mark.parametrize("seed", range(6))
def test_array_document_of_many_splits(spark, tmp_path, splits, seed):
    r = random.Random(seed)
    alphabet = 'a{}[]"\\,:\n é'
    records = [{"i": i, "t": cells(r, alphabet, 25), "n": {"x": [1, {"y": "}" * r.randint(0, 3)}], "z": {}}} for i in range(250)]
    records[100]["t"] = 'long "}' * r.choice([1, 1000])
    text = json.dumps(records, indent=[None, 1, 4][seed % 3], ensure_ascii=seed % 2 == 0)
    path = tmp_path / "t.json"
    path.write_bytes(("\ufeff" if seed == 3 else "").encode() + (" \n" + text + "\n ").encode())
    splits(r.choice([900, 2500]))
    cut = read_records(spark, str(path), json_grammar())
    assert cut.rdd.getNumPartitions() > 3
    assert [json.loads(x.record) for x in cut.orderBy("block", "row").collect()] == records
    df = read_table(spark, str(path), row_order=True)
    assert [x.t for x in df.orderBy(ORDER_COLUMN).collect()] == [x["t"] for x in records]
    whole = spark.read.option("multiLine", True).json(str(path))
    plain = df.drop(ORDER_COLUMN)
    assert plain.schema == whole.schema
    # A value that is not of one type is a text, which Spark takes as it stands in the record.
    assert rows(plain.drop("n")) == rows(whole.drop("n"))
    assert rows(read_table(spark, str(path), schema="t string, i int"), "i")[0] == (records[0]["t"], 0)


def test_small_documents(spark, tmp_path):
    for name, text in {"a": "[]", "b": " [ ] \n", "c": '[{"k":1}]', "d": '\n[ {"k":2} , {"k":{"x":"]"}} ]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = read_records(spark, str(tmp_path), json_grammar())
    assert sorted(r.record for r in found.collect()) == ['{"k":1}', '{"k":2}', '{"k":{"x":"]"}}']
    assert read_table(spark, str(tmp_path / "a.json")).count() == 0


@pytest.mark.parametrize("text", ['[{"k":1}', '[{"k":1},', '[{"k":1} {"k":2}]', '[{"k":1}, 5]', '[5, {"k":1}]', '[{"k":1}]]', '[{"k":"1}]'])
def test_broken_documents_fail(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|ends with"):
        read_table(spark, str(tmp_path / "t.json"), schema="k long").collect()


def test_several_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbf\n\nk,"v\nw"\n1,"x\r\ny"\n\n2,\n')
    (tmp_path / "b.csv").write_bytes(b'k,"v\nw"\r\n3,"z\n"')
    df = read_table(spark, str(tmp_path), "csv")
    assert df.columns == ["k", "v\nw"]
    assert rows(df, "k") == [(1, "x\r\ny"), (2, None), (3, "z\n")]
    (tmp_path / "c.csv").write_text('k,u\n4,"5\n"\n')
    with pytest.raises(Exception, match="another header|MALFORMED"):
        read_table(spark, str(tmp_path), "csv").collect()


def test_rows_of_other_lengths_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny",3\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, str(tmp_path / "a.csv"), schema="k long, v string").collect()


def test_bytes_of_another_charset_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('k,v\n1,"é\ny"\n'.encode("latin-1"))
    with pytest.raises(Exception, match="UnicodeDecodeError|decode"):
        read_table(spark, str(tmp_path / "a.csv"), schema="k long, v string").collect()


def test_options_and_separators(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('k;v;w\n1;"x\n;y";-\n2;"a,b";z\n')
    df = read_table(spark, str(path), sep=";", nullValue="-")
    assert rows(df, "k") == [(1, "x\n;y", None), (2, "a,b", "z")]
    assert rows(read_table(spark, str(path), sep=";", ignoreLeadingWhiteSpace=True), "k")[0] == (1, "x\n;y", "-")
    partitioned = tmp_path / "p" / "day=3"
    partitioned.mkdir(parents=True)
    (partitioned / "a.csv").write_text('k,v\n1,"x\ny"\n')
    assert rows(read_table(spark, str(tmp_path / "p"), "csv")) in ([(1, "x\ny", 3)], [(1, "x\ny", "3")])


def test_records_of_all_parts(spark, tmp_path, splits):
    """A record that covers several splits as a whole, between others."""
    (tmp_path / "t.csv").write_text('k\n1\n"' + "line\n" * 900 + '"\n3\n')
    splits(600)
    records = read_records(spark, str(tmp_path / "t.csv"), csv_grammar())
    found = [r.record for r in records.orderBy("block", "row").collect()]
    assert found == ["k", "1", '"' + "line\n" * 900 + '"', "3"]


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "cp932", "gb18030", "latin-1", "utf-8"])
def test_lines_of_many_splits(spark, tmp_path, splits, encoding):
    """Also where the bytes of a line feed stand within or between other characters."""
    r = random.Random(encoding)
    alphabet = "aé ਊ\u010a਀\u000cଊ日本" if "utf" in encoding else "aé " if encoding == "latin-1" else "a日本 "
    lines = [cells(r, alphabet, 20) for _ in range(300)] + ["end"]
    path = tmp_path / "t.txt"
    path.write_bytes(r.choice(["\n", "\r\n"]).join(lines).encode(encoding))
    splits(1200)
    df = read_lines(spark, str(path), keep_blank=True, encoding=encoding, errors="strict")
    assert df.rdd.getNumPartitions() >= 3
    assert [x.value for x in df.orderBy(ORDER_COLUMN).collect()] == lines
    numbered = number_lines(read_lines(spark, str(path), encoding=encoding, errors="strict"), df)
    found = {x.line_no: x.value for x in numbered.collect()}
    assert found == {i: line for i, line in enumerate(lines, 1) if line.strip()}


def test_lines_of_odd_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("\ufeffone\n\ntwo\n".encode("utf-16-be"))
    assert [x.value for x in read_lines(spark, str(tmp_path), encoding="utf-16").orderBy(ORDER_COLUMN).collect()] == ["one", "two"]
    (tmp_path / "u.txt").write_bytes(b"a\xffb\n")
    with pytest.raises(ValueError, match="byte orders"):
        read_lines(spark, str(tmp_path), encoding="utf-16")
    path = str(tmp_path / "u.txt")
    assert [x.value for x in read_lines(spark, path, encoding="euc_jp").collect()] == ["a\ufffdb"]
    with pytest.raises(Exception, match="decode"):
        read_lines(spark, path, encoding="euc_jp", errors="strict").collect()
    with pytest.raises(ValueError, match="cannot be told apart"):
        read_lines(spark, path, encoding="iso2022_jp")
