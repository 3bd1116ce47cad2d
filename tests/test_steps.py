import json
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.errors import DataQualityError, DeliveryError
from tidegate.operators.sql import sql_transform
from tidegate.plans.metrics import observed, observed_report, run_report
from tidegate.plans.steps import check_graph, run_graph, run_steps

CSV = """ref,amount,route
7001,80,HAM>OSL
7002,1250,"HAM>GOT>OSL"
7003,15,ROT>HAM>GOT>BGO
"""
QUERY = """-- where a parcel starts and ends
SELECT ref, amount, split_part(route, '>', 1) AS origin, split_part(route, '>', -1) AS target
FROM parcels;"""
TEMPLATE = """{# one parcel per row #}
{"type": "Parcel", "id": "urn:parcel:{{ ref }}",
 "weight": {"value": {{ amount }}, "unitCode": "GRM", "type": "Property"},
 "carriedTo": {"type": "Relationship", "object": "urn:port:{{ target | lower }}"},
 "@context": "https://context.example/parcels"}"""


@pytest.fixture
def chain(tmp_path):
    for name, text in {"in.csv": CSV, "q.sql": QUERY, "t.j2": TEMPLATE}.items():
        (tmp_path / name).write_text(text)
    at = lambda name: str(tmp_path / name)
    return [
        {"plugin": "with_duckdb", "params": {
            "input_path": at("in.csv"), "input_encoding": "utf-8", "output_path": at("mid.parquet"),
            "query_file": at("q.sql"), "table_name": "parcels"}},
        {"plugin": "with_jinja2", "params": {
            "input_path": at("mid.parquet"), "output_path": at("out.json"), "template_path": at("t.j2")}},
        {"plugin": "ngsi_validator", "params": {
            "input_path": at("out.json"), "output_path": at("checked.json")}},
    ]


def parcel(ref, grams, port):
    return {
        "id": f"urn:parcel:{ref}",
        "type": "Parcel",
        "weight": {"type": "Property", "value": grams, "unitCode": "GRM"},
        "carriedTo": {"type": "Relationship", "object": f"urn:port:{port}"},
        "@context": "https://context.example/parcels",
    }


PARCELS = [parcel(7001, 80, "osl"), parcel(7002, 1250, "osl"), parcel(7003, 15, "bgo")]


def test_chain(spark, chain, tmp_path):
    run = run_steps(spark, chain)
    assert list(run.written) == ["step_0", "step_1", "step_2"]
    lines = [r.value for r in spark.read.text(str(tmp_path / "checked.json")).collect()]
    assert sorted(map(json.loads, lines), key=str) == sorted(PARCELS, key=str)
    assert run.history == [("step_0", "with_duckdb"), ("step_1", "with_jinja2"), ("step_2", "ngsi_validator")]
    assert spark.read.parquet(str(tmp_path / "mid.parquet")).columns[3] == "target"
    assert list(run_steps(spark, chain, write="last").written) == ["step_2"]


def test_lines_become_columns_for_a_table_step(spark, chain, tmp_path):
    count = {"plugin": "with_spark", "params": {
        "input_path": chain[1]["params"]["output_path"], "output_path": str(tmp_path / "n.csv"),
        "query": "SELECT type AS value FROM source_data WHERE weight.value > 20"}}
    run = run_steps(spark, [*chain[:2], count])
    assert rows(run.result) == [("Parcel",), ("Parcel",)]
    assert spark.read.csv(run.written["step_2"], header=True).columns == ["value"]


def test_chain_is_one_plan(spark, chain):
    result = run_steps(spark, chain[:2], write="none").result
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_graph(spark, chain, tmp_path):
    edges = [("a", "b"), ("a", "c"), ("b", "d")]
    nodes = [
        {"id": "d", "plugin": "data_quality", "params": {
            "rules": [{"column": "n", "type": "in_range", "min": 1}], "output_path": str(tmp_path / "d.csv")}},
        {"id": "c", "plugin": "count_rows", "params": {"output_path": str(tmp_path / "c.parquet")}},
        {"id": "b", "plugin": "with_spark", "params": {"query": "SELECT target, count(*) AS n FROM t GROUP BY 1", "table_name": "t"}},
        {"id": "a", **chain[0]},
    ]
    spec = {"nodes": nodes, "edges": [{"source_node_id": s, "target_node_id": t} for s, t in edges]}
    own = {"count_rows": lambda df: df.agg(F.count("*").alias("rows"))}
    run = run_graph(spark, spec, own=own)
    assert set(run.written) == {"a", "c", "d"}
    assert rows(spark.read.parquet(run.written["c"])) == [(3,)]
    assert spark.read.csv(run.written["d"], header=True).count() == 2
    assert set(run_graph(spark, spec, own=own, write="sinks").written) == {"c", "d"}
    assert [step for step, _ in run.history][0] == "a"
    for share in ("write", "recompute"):
        again = run_graph(spark, spec, own=own, share=share)
        assert rows(spark.read.parquet(again.written["c"])) == [(3,)]


def test_graph_checks():
    def check(ids, *edges):
        nodes = [{"id": i} for i in ids]
        return check_graph(nodes, [{"source_node_id": s, "target_node_id": t} for s, t in edges])

    assert check("cab", "ab", "bc") == ["a", "b", "c"]
    for ids, edges, text in (
        ("", [], "at least one"),
        ("aa", [], "Duplicate"),
        ("a", ["ax"], "unknown"),
        ("abc", ["ac", "bc"], "more than one"),
        ("ab", ["ab", "ba"], "cycle"),
        ("a", ["aa"], "cycle"),
    ):
        with pytest.raises(ValueError, match=text):
            check(ids, *edges)


def test_step_errors(spark, chain):
    with pytest.raises(ValueError, match="empty"):
        run_steps(spark, [])
    with pytest.raises(ValueError, match="Unknown step"):
        run_steps(spark, [{"plugin": "sparkle"}], spark.range(1))
    with pytest.raises(ValueError, match="no input"):
        run_steps(spark, [{"plugin": "with_spark", "params": {"query": "SELECT 1"}}])
    with pytest.raises(TypeError, match="not a DataFrame"):
        run_steps(spark, [{"plugin": lambda df: 5}], spark.range(1))
    gate = {"plugin": "business_rules", "params": {"rules": [{"name": "heavy", "expression": "amount > 1000"}]}}
    with pytest.raises(DataQualityError, match="Rule 'heavy' failed for 1 rows"):
        run_steps(spark, [chain[0], gate])


def test_file_order_steps(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\na,1\nb,\na,3\n")
    steps = [{"plugin": "duplicate_remover", "params": {
        "input_path": str(tmp_path / "t.csv"), "subset": ["k"], "keep": "last", "output_path": str(tmp_path / "o.csv")}},
        {"plugin": "null_handler", "params": {"strategy": "fill", "method": "bfill"}}]
    found = run_steps(spark, steps, write="none").result
    assert rows(found.select("k", "v")) == [("a", 3), ("b", 3)]
    run_steps(spark, steps, write="all")
    assert spark.read.csv(str(tmp_path / "o.csv"), header=True).columns == ["k", "v"]


def test_json_steps(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"required": ["k"]}')
    (tmp_path / "rows.jsonl").write_text('{"j": "{\\"k\\": 1}"}\n{"j": "{}"}\n')
    step = {"plugin": "json_schema", "params": {
        "input_path": str(tmp_path / "rows.jsonl"), "schema_path": str(tmp_path / "s.json"), "target_column": "j"}}
    with pytest.raises(DataQualityError, match="'k' is a required property"):
        run_steps(spark, [step])
    (tmp_path / "e.json").write_text('{"id":1,"type":"t"}\n{"id":1}\n{bad\n')
    step = {"plugin": "ngsi_validator", "params": {"input_path": str(tmp_path / "e.json")}}
    with pytest.raises(DataQualityError) as first:
        run_steps(spark, [step])
    assert str(first.value) == "Missing 'type'."
    step["params"]["stop_on_first_error"] = False
    with pytest.raises(DataQualityError, match="for 2 records"):
        run_steps(spark, [step])
    unordered = {"plugin": "ngsi_validator", "params": {"stop_on_first_error": True}}
    with pytest.raises(ValueError, match="no order"):
        run_steps(spark, [unordered], spark.createDataFrame([("{}",)], "value string"))


def test_http_step(spark, tmp_path):
    (tmp_path / "e.json").write_text("one\n\ntwo\n")
    step = {"plugin": "to_http", "params": {
        "input_path": str(tmp_path / "e.json"), "send": lambda p, k: 500 if p == "two" else 200}}
    with pytest.raises(DeliveryError, match="1 requests failed"):
        run_steps(spark, [step])
    step["params"]["stop_on_fail"] = False
    assert run_steps(spark, [step]).result.count() == 2


def test_file_steps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("日本".encode("utf-16"))
    folder = str(tmp_path / "in")
    converted = run_steps(spark, [{"plugin": "encoding_converter", "params": {"input_path": folder}}])
    assert converted.result.first().text == "日本"
    found = run_steps(spark, [{"plugin": "format_detector", "params": {"input_path": folder}}])
    assert found.result.first().detected_format == "binary"
    out = tmp_path / "out"
    run_steps(spark, [{"plugin": "encoding_converter", "params": {"input_path": folder, "output_path": str(out)}}])
    assert (out / "a.txt").read_text(encoding="utf-8") == "日本"
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as archive:
        archive.writestr("top/x/y.txt", "inside")
    run_steps(spark, [{"plugin": "archive_extractor", "params": {
        "input_path": folder + "/z.zip", "output_path": str(out), "strip_components": 1}}])
    assert (out / "z.zip" / "x" / "y.txt").read_text() == "inside"


def test_files_of_one_name(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.txt").write_text(name)
        with zipfile.ZipFile(tmp_path / "in" / name / "z.zip", "w") as archive:
            archive.writestr("b.txt", name)
    zips, texts = tmp_path / "zips", tmp_path / "texts"
    for plugin, pattern, out in (("archive_extractor", "*.zip", zips), ("encoding_converter", "*.txt", texts)):
        folder = tmp_path / plugin
        for name in ("one", "two"):
            (folder / name).mkdir(parents=True)
            for file in (tmp_path / "in" / name).glob(pattern):
                (folder / name / file.name).write_bytes(file.read_bytes())
        run_steps(spark, [{"plugin": plugin, "params": {"input_path": str(folder), "output_path": str(out)}}])
    assert [(zips / n / "z.zip" / "b.txt").read_text() for n in ("one", "two")] == ["one", "two"]
    assert [(texts / n / "a.txt").read_text() for n in ("one", "two")] == ["one", "two"]


def test_memory_tables_between_runs(spark, chain):
    chain[0]["params"]["output_path"] = "memory://run/mid.parquet"
    run_steps(spark, chain[:1])
    step = {"plugin": "with_spark", "params": {
        "input_path": "memory://run/mid.parquet", "query": "SELECT max(amount) AS t FROM source_data"}}
    assert run_steps(spark, [step]).result.first().t == 1250


def test_metrics(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (2, 3.0)], "k long, v double")
    found = rows(run_report([("s1", "read", df), ("s2", "drop", df.na.drop())]))
    expected = [
        ("s1", "read", "nulls", 2), ("s1", "read", "rows", 3),
        ("s2", "drop", "nulls", 0), ("s2", "drop", "rows", 1),
    ]
    assert found == expected
    first, seen = observed(df, "in")
    second, left = observed(first.na.drop(), "out")
    second.write.format("noop").mode("overwrite").save()
    assert rows(observed_report(spark, [("s1", "read", seen), ("s2", "drop", left)])) == expected


def test_sql_leaves_no_views(spark):
    spark.range(7).createOrReplaceTempView("source_data")
    other = spark.range(3).withColumnRenamed("id", "k")
    found = sql_transform(spark.range(5), "SELECT count(*) AS n FROM source_data JOIN o ON id = k", views={"o": other})
    again = sql_transform(spark.range(2), "SELECT count(*) AS n FROM source_data;")
    assert (found.first().n, again.first().n, spark.table("source_data").count()) == (3, 2, 7)
    assert not spark.catalog.tableExists("o")
    spark.catalog.dropTempView("source_data")
