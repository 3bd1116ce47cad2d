"""Queries that make files of tables: more rows make more files, not larger ones."""

import pytest

from conformance import files


@pytest.mark.parametrize("make", [files._json_document, files._json_kinds, files._renamed_tars])
def test_files_grow_in_number(spark, monkeypatch, make):
    rows, written = files.table, []

    class Written(Exception):
        pass

    def write(df, *_):
        written.append(df.count())
        raise Written

    def doubled(*args):
        df = rows(*args)
        key = df.columns[1 if "o_custkey" in df.columns else 0]
        top = df.selectExpr(f"max({key})").first()[0]
        return df.union(df.withColumn(key, df[key] + top + 1))

    monkeypatch.setattr(files, "write_files", write)
    for table in (rows, doubled):
        monkeypatch.setattr(files, "table", table)
        with pytest.raises(Written):
            make(spark, "/root/testdata/sf0.01")
    assert 1 < written[0] < written[1] and abs(written[1] - 2 * written[0]) <= 2
