"""Landed files judged one by one: a batch of all bodies against a run of each body alone."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.errors import DataQualityError
from tidegate.plans.steps import run_steps
from tidegate.streaming.bodies import ingest_bodies, run_bodies
from tidegate.streaming.ingest import BODY, MALFORMED, read_landing

SCHEMA = "k string, v long"


def land(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)


def lines(*records):
    return "".join(json.dumps(r) + "\n" for r in records)


def ingested(spark, tmp_path, steps, fmt="jsonl", own=None, **options):
    out = str(tmp_path / "out")
    stream = read_landing(spark, str(tmp_path / "in"), fmt, SCHEMA, **options)
    ingest_bodies(stream, steps, out, str(tmp_path / "log"), own).awaitTermination(120)
    name = F.substring_index(BODY, "/", -1).alias("body")
    reports = spark.read.parquet(out + ".reports").select(name, "status", "step", "message", "rows_in", "rows_out")
    return spark.read.parquet(out).withColumn("body", name), spark.read.parquet(out + ".rejected"), rows(reports)


def test_one_batch_of_good_and_bad_bodies(spark, tmp_path):
    land(
        tmp_path / "in",
        {
            "a.jsonl": lines({"k": "x", "v": 1}, {"k": "x", "v": 2}, {"k": "y", "v": 3}),
            "b.jsonl": lines({"k": "x", "v": -1}, {"k": None, "v": -2}),
            "c.jsonl": lines({"k": "x", "v": 900}),
            "d.jsonl": lines({"k": "x", "v": 1}) + '{"k": "y", "v":\n',
        },
    )
    steps = [
        {"plugin": "duplicate_remover", "params": {"subset": ["k"], "order_by": "v"}},
        {"plugin": "data_quality", "params": {"rules": [
            {"column": "v", "type": "in_range", "min": 0}, {"column": "k", "type": "not_null"}, {"column": "k", "type": "is_unique"}]}},
        {"plugin": "with_spark", "params": {"query": "SELECT *, v * 2 AS w FROM source_data"}},
        {"plugin": "business_rules", "params": {"rules": [{"name": "large", "expression": "w > 1000"}]}},
    ]
    good, rejected, reports = ingested(spark, tmp_path, steps, on_malformed="mark")
    assert rows(good.select("body", "k", "v", "w")) == [("a.jsonl", "x", 1, 2), ("a.jsonl", "y", 3, 6)]
    quality = (
        "Data quality validation failed:\n- Column 'v' has values out of range.\n- Column 'k' has nulls."
    )
    business = "Business rule validation failed:\n- Rule 'large' failed for 1 rows. (Expression: 'w > 1000')."
    assert reports == [
        ("a.jsonl", "ok", None, None, 3, 2),
        ("b.jsonl", "error", "data_quality", quality, 2, 0),
        ("c.jsonl", "error", "business_rules", business, 1, 0),
        ("d.jsonl", "error", "read", 'Malformed records: 1, such as: {"k": "y", "v":', 2, 0),
    ]
    assert rejected.count() == 5 and {r.v for r in rejected.collect()} == {-1, -2, 900, 1, None}
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count_distinct("batch")).first()[0] == 1


RULES = [
    {"column": "k", "type": "is_unique"}, {"column": "v", "type": "not_null"}, {"column": "v", "type": "is_unique"},
    {"column": "k", "type": "matches_regex", "pattern": "[a-c]"}, {"column": "k", "type": "in_set", "values": ["a", "b"]},
]


def test_messages_are_those_of_single_runs(spark):
    """Every body gets the verdict and the rows that it gets alone."""
    bodies = {
        "one": [("a", 1), ("b", 2)], "two": [("a", 1), ("a", 2)], "three": [(None, 1), (None, 2), ("d", None)],
        "four": [("a", None)], "five": [("c", 5)] * 3, "six": [("b", 7)],
    }
    df = spark.createDataFrame([(b, k, v) for b, found in bodies.items() for k, v in found], f"{BODY} string, {SCHEMA}")
    steps = [{"plugin": "data_quality", "params": {"rules": RULES}}]
    judged = run_bodies(df, steps)
    refused = {r[BODY]: r.message for r in judged.refused.collect()}
    kept = {r[BODY] for r in judged.rows.collect()}
    for body in bodies:
        try:
            run_steps(spark, steps, df.filter(F.col(BODY) == body).drop(BODY), write="none").result.collect()
            assert body in kept and body not in refused
        except DataQualityError as error:
            assert refused[body] == str(error) and body not in kept


def test_validations_and_rendering(spark):
    entity = '{"id":"urn:ngsi-ld:T:1","type":"T","v":{"type":"Property","value":1}}'
    df = spark.createDataFrame(
        [("a", entity), ("b", entity), ("b", '{"id":5}'), ("c", "[]"), ("c", "nothing")], f"{BODY} string, value string"
    )
    for step in (
        {"plugin": "ngsi_validator", "params": {"ngsi_version": "ld"}},
        {"plugin": "json_schema", "params": {"target_column": "value", "schema": {"type": "object", "required": ["type"]}}},
    ):
        judged = run_bodies(df, [step, {"plugin": "with_jinja2", "params": {"template": '{"e": {{ value }}}'}}])
        assert [(r[BODY], json.loads(r.value)["e"]["type"]) for r in judged.rows.collect()] == [("a", "T")]
        for r in judged.refused.collect():
            alone = df.filter(F.col(BODY) == r[BODY]).drop(BODY)
            with pytest.raises(DataQualityError) as error:
                run_steps(spark, [step], alone, write="none")
            assert sorted(r.message.split("\n")) == sorted(str(error.value).split("\n"))


def test_gaps_are_filled_within_a_body(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("b", 1, None), ("b", 2, "y")], f"{BODY} string, i long, k string"
    )
    step = {"plugin": "null_handler", "params": {"strategy": "fill", "method": "ffill", "order_by": "i"}}
    found = rows(run_bodies(df, [step]).rows.select(BODY, "i", "k"))
    assert found == [("a", 1, "x"), ("a", 2, "x"), ("b", 1, None), ("b", 2, "y")]


def test_csv_cells_and_rows(spark, tmp_path):
    land(tmp_path / "in", {"a.csv": "k,v\nx,1\n", "b.csv": "k,v\nx,one\ny,2\n", "c.csv": "k,v\nx,1,2\n", "d.csv": "k,v\n,NA\n"})
    good, _, reports = ingested(spark, tmp_path, [{"plugin": "receive_http"}], "csv", on_malformed="mark")
    assert rows(good.select("body", "k", "v")) == [("a.csv", "x", 1), ("d.csv", None, None)]
    assert [(r[0], r[1], r[3]) for r in reports] == [
        ("a.csv", "ok", None), ("b.csv", "error", "Malformed records: 1, such as: v: one"),
        ("c.csv", "error", "Malformed records: 1, such as: x,1,2"), ("d.csv", "ok", None),
    ]


def test_steps_have_to_keep_the_body(spark):
    df = spark.createDataFrame([("a", "x", 1)], f"{BODY} string, {SCHEMA}")
    with pytest.raises(ValueError, match="has to keep"):
        run_bodies(df, [{"plugin": "with_spark", "params": {"query": "SELECT k FROM source_data"}}])
    with pytest.raises(ValueError, match="does not work on single bodies"):
        run_bodies(df, [{"plugin": "archive_extractor"}])
    own = {"twice": lambda df, n: df.withColumn("v", F.col("v") * n)}
    assert run_bodies(df, [{"plugin": "twice", "params": {"n": 2}}], own).rows.first().v == 2
    empty = run_bodies(df.limit(0).withColumn(MALFORMED, F.lit(None).cast("string")), [{"plugin": "data_quality", "params": {"rules": RULES}}])
    assert empty.rows.count() == empty.refused.count() == 0
