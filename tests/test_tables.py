import datetime
import os

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.functions.missing import ORDER_COLUMN
from tidegate.operators.dedupe import drop_duplicates
from tidegate.operators.nulls import carry
from tidegate.sources.files import file_catalog, list_files, path_info, read_files, write_files
from tidegate.sources.named import clear_named, get_named, list_named, put_named
from tidegate.sources.tables import convert, read_table, write_table
from tidegate.sources.text import number_lines, read_lines, write_lines

MICROS = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)


def write_text(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "jsonl"])
def test_round_trip(spark, tmp_path, fmt):
    schema = "a long, x double, s string, ok boolean, ts timestamp_ntz"
    data = [
        (1, 1.5, 'say "hi", ok', True, MICROS),
        (2, None, "two\nlines", False, None),
        (None, -2.0, None, None, MICROS),
    ]
    path = str(tmp_path / f"t.{fmt}")
    df = spark.createDataFrame(data, schema)
    write_table(df, path)
    back = read_table(spark, path, schema=schema)
    assert rows(back) == rows(df)
    write_table(df.limit(1), path)
    assert read_table(spark, path, schema=schema).count() == 1


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = write_text(
        tmp_path / "t.csv",
        'i,x,b,s,t,e\n1,1.5,True,NA,2024-01-01T00:00:00Z,\nNaN,2,false,"a ""q"", b",x,\n-3,nan,,null,1d,\n',
    )
    df = read_table(spark, path)
    pdf = pd.read_csv(path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert [r.s for r in df.collect()] == [None if v != v else v for v in pdf.s]
    assert rows(df.select("i", "x", "b"), "i") == [(None, 2.0, False), (-3, None, None), (1, 1.5, True)]


def test_csv_multiline_is_found(spark, tmp_path):
    path = write_text(tmp_path / "m.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows(read_table(spark, path)) == [(1, "x\ny"), (2, "z")]


def test_csv_header_only(spark, tmp_path):
    df = read_table(spark, write_text(tmp_path / "h.csv", "col1,col2\n"))
    assert df.columns == ["col1", "col2"] and df.count() == 0


@pytest.mark.parametrize(
    "encoding", ["utf-8", "utf-16", "utf-8-sig", "shift_jis", "cp932", "latin-1", "cp1251", "gb18030", "big5"]
)
def test_encodings(spark, tmp_path, encoding):
    word = {"latin-1": "Zürich", "cp1251": "Москва"}.get(encoding, "日本語")
    path = write_text(tmp_path / "t.csv", f'name,n\n{word},1\n"two\nlines, {word}",2\n', encoding)
    df = read_table(spark, path, encoding=encoding)
    assert df.columns == ["name", "n"]
    assert rows(df, "n") == [(word, 1), (f"two\nlines, {word}", 2)]
    if encoding == "utf-16":  # Spark reads JSON lines of wide characters only with a line separator
        return
    lines = write_text(tmp_path / "t.jsonl", f'{{"name":"{word}","n":1}}\n{{"name":null,"n":2}}\n', encoding)
    assert rows(read_table(spark, lines, encoding=encoding).select("n", "name"), "n") == [(1, word), (2, None)]


def test_charsets_that_need_the_switch(spark, tmp_path):
    df = spark.range(1)
    for use in (
        lambda: write_table(df, str(tmp_path / "t.csv"), encoding="cp932"),
        lambda: read_table(spark, write_text(tmp_path / "j.csv", "日本\n1\n", "iso2022_jp"), encoding="iso2022_jp"),
    ):
        with pytest.raises(ValueError, match="javaCharsets"):
            use()


def test_json_document_and_lines(spark, tmp_path):
    array = write_text(tmp_path / "a.json", '[\n {"col": true},\n {"col": false}\n]')
    lines = write_text(tmp_path / "a.jsonl", '{"col": true}\n{"col": false}\n')
    assert rows(read_table(spark, array)) == rows(read_table(spark, lines)) == [(False,), (True,)]


def test_convert(spark, tmp_path):
    source = write_text(tmp_path / "t.csv", "a,s\n1,x\n2,\n")
    for name in ("p.parquet", "l.jsonl"):
        target = str(tmp_path / name)
        convert(spark, source, target)
        assert rows(read_table(spark, target)) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        convert(spark, source, str(tmp_path / "t.xlsx"))


def test_file_order(spark, tmp_path):
    path = write_text(tmp_path / "t.csv", "k,v\na,1\nb,\na,3\nb,4\n,5\n")
    df = read_table(spark, path, row_order=True)
    assert rows(drop_duplicates(df, ["k"], "first").drop(ORDER_COLUMN)) == [("a", 1), ("b", None), (None, 5)]
    assert rows(drop_duplicates(df, ["k"], "last").drop(ORDER_COLUMN)) == [("a", 3), ("b", 4), (None, 5)]
    filled = carry(df, "ffill", columns=["k", "v"])
    assert [tuple(r)[:2] for r in filled.orderBy(ORDER_COLUMN).collect()] == [
        ("a", 1), ("b", 1), ("a", 3), ("b", 4), ("b", 5),
    ]


def test_file_order_over_many_files(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 90 == 5, F.col("id")).alias("v")
    )
    path = str(tmp_path / "many.parquet")
    df.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    found = carry(read_table(spark, path, row_order=True), "ffill", columns=["v"])
    expected = [(i, (i - 5) // 90 * 90 + 5 if i >= 5 else None) for i in range(1000)]
    assert rows(found.select("id", "v"), "id") == expected


def test_lines(spark, tmp_path):
    write_text(tmp_path / "a.txt", "one\n\ntwo\n   \nthree\n")
    write_text(tmp_path / "b.txt", "\nfour")
    folder = str(tmp_path)
    lines = read_lines(spark, folder)
    numbered = number_lines(lines, read_lines(spark, folder, keep_blank=True))
    found = rows(numbered.select(F.substring_index("file", "/", -1), "line_no", "value"))
    assert found == [("a.txt", 1, "one"), ("a.txt", 3, "two"), ("a.txt", 5, "three"), ("b.txt", 2, "four")]
    write_lines(lines.orderBy("value"), F.upper("value"), folder + "/out")
    assert sorted(r.value for r in spark.read.text(folder + "/out").collect()) == ["FOUR", "ONE", "THREE", "TWO"]


def test_line_numbers_across_blocks(spark, tmp_path):
    path = write_text(tmp_path / "big.txt", "".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 3
        numbered = number_lines(lines, read_lines(spark, path, keep_blank=True), start=0)
        wrong = numbered.where(F.concat(F.lit("line "), F.col("line_no")) != F.col("value"))
        assert numbered.count() == 20_000 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_catalog(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    write_text(tmp_path / "a.csv", "a\n1\n")
    write_text(tmp_path / "sub" / "b.TXT", "hello")
    catalog = file_catalog(spark, str(tmp_path))
    found = rows(catalog.select(F.substring_index("path", "/", -1), "length", "format"))
    assert found == [("a.csv", 4, "csv"), ("b.TXT", 5, "text")]
    contents = read_files(spark, str(tmp_path), glob="*.csv").select("content").collect()
    assert [bytes(r.content) for r in contents] == [b"a\n1\n"]


def test_path_info(tmp_path):
    write_text(tmp_path / "a.txt", "four")
    info = path_info(str(tmp_path / "a.txt"))
    assert (info.is_dir, info.length) == (False, 4) and info.modified.year > 2000
    assert path_info(tmp_path.as_uri()).is_dir
    assert path_info(str(tmp_path / "b.txt")) is None


def test_empty_files_are_listed(spark, tmp_path):
    for name in ("e", "a/e.txt", "a/b/e.txt", "_hidden/e.txt", "a/.x", "full/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" if "full" in name else b"")
    base = f"file:{tmp_path}/"
    expected = [base + name for name in ("a/b/e.txt", "a/e.txt", "e", "full/f.txt")]
    for path in (str(tmp_path), tmp_path.as_uri(), base):
        found = file_catalog(spark, path).orderBy("path").collect()
        assert [r.path for r in found] == expected
        assert [r.length for r in found] == [0, 0, 0, 1]
    assert file_catalog(spark, str(tmp_path), glob="*.txt").count() == 3
    assert file_catalog(spark, str(tmp_path / "e")).count() == 1
    assert file_catalog(spark, str(tmp_path), with_empty=False).count() == 1
    assert [bytes(r.content) for r in read_files(spark, str(tmp_path / "a")).collect()] == [b"", b""]
    with pytest.raises(ValueError):
        file_catalog(spark, str(tmp_path / "*"))


def test_trees_of_folders(spark, tmp_path):
    """A deep tree, a flat folder and many folders, by path, size and name."""
    expected = {}
    for name in ["/".join(["d"] * depth) + f"/f{depth}.txt" for depth in range(1, 9)] + [
        *(f"flat/{i}.csv" for i in range(300)), *(f"wide/{i}/x {i} é%.json" for i in range(40)), "top.txt",
    ]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (len(name) % 5))
        expected[f"file:{tmp_path}/{name}"] = len(name) % 5
    (tmp_path / "wide" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "wide" / "_temporary" / "0" / "part").write_text("x")
    (tmp_path / "none" / "here").mkdir(parents=True)
    found = list_files(spark, str(tmp_path))
    assert {r.path: r.length for r in found.collect()} == expected and found.count() == len(expected)
    assert list_files(spark, str(tmp_path), "f?.txt").count() == 8
    assert list_files(spark, str(tmp_path / "none")).count() == 0
    assert [r.length for r in list_files(spark, str(tmp_path / "top.txt")).collect()] == [2]
    assert all(r.modified.year > 2000 for r in found.collect())


def test_write_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("a/b.txt", bytearray(b"1")), ("c.bin.gz", bytearray(b"\x00\xff")), ("empty", bytearray())],
        "member string, content binary",
    )
    done = write_files(df, str(tmp_path / "out"), "member", "content")
    assert (done.files, done.bytes) == (3, 3)
    assert (tmp_path / "out" / "a" / "b.txt").read_bytes() == b"1"
    assert (tmp_path / "out" / "c.bin.gz").read_bytes() == b"\x00\xff"
    write_files(df, (tmp_path / "uri").as_uri(), "member", "content")
    assert (tmp_path / "uri" / "empty").read_bytes() == b""
    for bad in ("../x", "/x", "a/../../x", "", None):
        with pytest.raises(Exception, match="leaves the target folder|has no path"):
            write_files(spark.createDataFrame([(bad, bytearray())], df.schema), str(tmp_path / "no"), "member", "content")
    with pytest.raises(ValueError, match="same path"):
        write_files(df.union(df), str(tmp_path / "twice"), "member", "content")


def test_named_tables(spark):
    put_named(spark.range(3), "memory://stage/a.parquet")
    put_named(spark.range(4), "memory://stage/b-c.parquet", persist=True)
    put_named(spark.range(5), "memory://other")
    assert get_named(spark, "memory://stage/b-c.parquet").count() == 4
    assert list_named(spark, "memory://stage/") == ["memory://stage/a.parquet", "memory://stage/b-c.parquet"]
    assert clear_named(spark, "memory://stage/") == 2
    with pytest.raises(KeyError):
        get_named(spark, "memory://stage/a.parquet")
    assert clear_named(spark, "memory://other") == 1


def test_first_bytes_may_end_within_a_character(spark, tmp_path):
    for name, front in (("a", "["), ("b", " ["), ("c", "  [")):
        rows = [f'{{"id": {i}, "text": "{"né日本" * 800}"}}' for i in range(3)]
        (tmp_path / f"{name}.json").write_text(front + ",\n".join(rows) + "]", encoding="utf-8")
    found = read_table(spark, str(tmp_path), "json")
    assert found.count() == 9
    assert found.select("text").distinct().collect()[0].text == "né日本" * 800
    (tmp_path / "lines.json").write_text(f'{{"id": 7, "text": "{"né日本" * 800}"}}\n', encoding="utf-8")
    assert read_table(spark, str(tmp_path), "json").count() == 10
