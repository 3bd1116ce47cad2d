import pytest
from conftest import rows

from tidegate.streaming.ingest import ingest, ingest_batches, read_landing

SCHEMA = "k string, v long"


def land(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_ingest_only_new_files(spark, tmp_path):
    landing, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    steps = [{"plugin": "with_spark", "params": {"query": "SELECT upper(k) AS k, v * 2 AS w FROM source_data"}}]

    def run():
        stream = read_landing(spark, str(landing), "csv", SCHEMA)
        ingest(stream, steps, out, log).awaitTermination(120)
        return rows(spark.read.parquet(out))

    land(landing, "a.csv", 'k,v\nx,1\n"a ""b""",2\nNA,\n')
    assert run() == [('A "B"', 4), ("X", 2), (None, None)]
    land(landing, "b.csv", "k,v\ny,5\n")
    assert run() == [('A "B"', 4), ("X", 2), ("Y", 10), (None, None)]


def test_batches_with_gate(spark, tmp_path):
    landing, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    land(landing, "a.jsonl", '{"k":"x","v":1}\n{"k":"x","v":2}\n')
    land(landing, "b.jsonl", '{"k":"y","v":-1}\n')
    steps = [
        {"plugin": "duplicate_remover", "params": {"subset": ["k"], "order_by": "v"}},
        {"plugin": "data_quality", "params": {"rules": [{"column": "v", "type": "in_range", "min": 0}]}},
    ]
    stream = read_landing(spark, str(landing), "jsonl", SCHEMA, files_per_batch=1)
    ingest_batches(stream, steps, out, log, on_error="skip").awaitTermination(120)
    assert rows(spark.read.parquet(out).select("k", "v")) == [("x", 1)]
    reports = spark.read.parquet(out + ".reports").select("status", "bodies", "rows_in", "rows_out")
    assert rows(reports) == [("error", 1, 1, 0), ("ok", 1, 2, 1)]

    failing = ingest_batches(
        read_landing(spark, str(landing), "jsonl", SCHEMA), steps, out + "2", log + "2"
    )
    with pytest.raises(Exception, match="out of range"):
        failing.awaitTermination(120)


@pytest.mark.parametrize("name, text", [("a.csv", "k,v\nx,foo\n"), ("a.csv", "k,v\nx,1,2\n"), ("a.jsonl", '{"k":"x","v":\n')])
def test_bad_input_fails_the_stream(spark, tmp_path, name, text):
    land(tmp_path / "in", name, text)
    stream = read_landing(spark, str(tmp_path / "in"), name.split(".")[1], SCHEMA)
    steps = [{"plugin": "with_spark", "params": {"query": "SELECT * FROM source_data"}}]
    with pytest.raises(Exception, match="(?i)malformed|cast|FAILED_READ_FILE"):
        ingest(stream, steps, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)


def test_skip_is_for_gates_only(spark, tmp_path):
    land(tmp_path / "in", "a.jsonl", '{"k":"x","v":1}\n')

    def broken(df):
        raise RuntimeError("disk full")

    stream = read_landing(spark, str(tmp_path / "in"), "jsonl", SCHEMA)
    query = ingest_batches(stream, [{"plugin": broken}], str(tmp_path / "o"), str(tmp_path / "l"), on_error="skip")
    with pytest.raises(Exception, match="disk full"):
        query.awaitTermination(120)
