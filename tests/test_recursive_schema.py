"""Recursive JSON Schemas against a walk over the documents."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.functions import json_schema
from tidegate.operators.validate_json import schema_violations, with_schema_errors

TREE = {
    "definitions": {
        "node": {
            "type": "object", "required": ["v"],
            "properties": {"v": {"type": "integer", "maximum": 7}, "kids": {"type": "array", "items": {"$ref": "#/definitions/node"}},
                           "by": {"additionalProperties": {"$ref": "#/definitions/leaf"}}},
        },
        "leaf": {"type": ["object", "string"], "properties": {"up": {"$ref": "#/definitions/node"}, "n~/x": {"$ref": "#"}}},
    },
    "properties": {"root": {"$ref": "#/definitions/node"}, "next": {"$ref": "#"}},
}


def walk(kind, x, path, found):
    """Violations of TREE, written down by hand."""
    here = path or "" if path else ""
    at = lambda key: f"{path}/{key}" if path else str(key)
    if kind == "root":
        if isinstance(x, dict):
            for key, inner in (("root", "node"), ("next", "root")):
                if key in x:
                    walk(inner, x[key], at(key), found)
    elif kind == "node":
        if not isinstance(x, dict):
            found.append(f"{here}: {shown(x)} is not of type 'object'")
            return
        if "v" not in x:
            found.append(f"{here}: 'v' is a required property")
        elif not isinstance(x["v"], int):
            found.append(f"{at('v')}: {shown(x['v'])} is not of type 'integer'")
        elif x["v"] > 7:
            found.append(f"{at('v')}: {x['v']} is greater than the maximum of 7")
        kids = x.get("kids", [])
        if not isinstance(kids, list):
            found.append(f"{at('kids')}: {shown(kids)} is not of type 'array'")
            kids = []
        for i, kid in enumerate(kids):
            walk("node", kid, at(f"kids/{i}"), found)
        for key, value in x.get("by", {}).items():
            walk("leaf", value, at(f"by/{key}"), found)
    elif isinstance(x, dict):
        for key, inner in (("up", "node"), ("n~/x", "root")):
            if key in x:
                walk(inner, x[key], at(key), found)
    elif not isinstance(x, str):
        found.append(f"{here}: {shown(x)} is not of type 'object', 'string'")


def shown(x):
    return f"'{x}'" if isinstance(x, str) else json.dumps(x, separators=(",", ":"))


def tree(r, depth, kind):
    if r.random() < 0.08:
        return r.choice([5, "word", [1]])
    if kind == "leaf":
        return {k: tree(r, depth - 1, "node" if k == "up" else "root") for k in ("up", "n~/x") if depth and r.random() < 0.5}
    if kind == "root":
        return {k: tree(r, depth - 1, "node" if k == "root" else "root") for k in ("root", "next") if depth and r.random() < 0.8}
    x = {"v": r.choice([1, 2, 9, "9"])} if r.random() < 0.9 else {}
    if depth:
        x["kids"] = [tree(r, depth - 1, "node") for _ in range(r.randint(0, 3))] if r.random() < 0.9 else 3
        x["by"] = {f"k{i}": tree(r, depth - 1, "leaf") for i in range(r.randint(0, 2))}
    return x


def test_trees(spark):
    r = random.Random(3)
    documents = [tree(r, i % 7, "root") for i in range(150)] + [{}, {"root": {"v": 1}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i long, j string")
    found = {x.i: x["_errors"] for x in with_schema_errors(df, "j", TREE).collect()}
    assert len(found) == len(documents)
    for i, document in enumerate(documents):
        expected = []
        walk("root", document, "", expected)
        assert sorted(found[i]) == sorted(expected), document
    assert sum(map(len, found.values())) > 200


def test_depth_has_no_limit(spark):
    schema = {"type": "object", "properties": {"v": {"maximum": 7}, "next": {"$ref": "#"}}}
    documents = []
    for depth in (0, 1, 30):
        x = {"v": 9}
        for _ in range(depth):
            x = {"v": 1, "next": x}
        documents.append((depth, json.dumps(x), "kept"))
    df = spark.createDataFrame([*documents, (5, "{", "kept"), (6, None, "kept")], "i long, j string, k string")
    found = {x.i: (x["_errors"], x.k) for x in schema_violations(df, "j", schema).collect()}
    assert found == {
        **{d: (["next/" * d + "v: 9 is greater than the maximum of 7"], "kept") for d in (0, 1, 30)},
        5: (["Invalid JSON string."], "kept"), 6: ([": null is not of type 'object'".replace("null", "None")], "kept"),
    }


def test_what_is_refused(spark):
    df = spark.createDataFrame([("{}",)], "j string")
    for schema in (
        {"$ref": "#"},
        {"definitions": {"a": {"$ref": "#/definitions/b"}, "b": {"allOf": [{"$ref": "#/definitions/a"}]}}, "$ref": "#/definitions/a"},
        {"properties": {"next": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}}},
        {"not": {"properties": {"x": {"$ref": "#"}}}},
    ):
        with pytest.raises(ValueError, match="leads to itself|are not supported within"):
            with_schema_errors(df, "j", schema)
    twice = {"definitions": {"p": {"type": "string"}}, "properties": {"a": {"$ref": "#/definitions/p"}, "b": {"$ref": "#/definitions/p"}}}
    good = spark.createDataFrame([('{"a":"x","b":1}',)], "j string")
    assert rows(with_schema_errors(good, "j", twice).select("_errors")) == [(["b: 1 is not of type 'string'"],)]


def test_rows_are_written_once_in_some_levels(spark, monkeypatch):
    folders = []
    plain = json_schema.scratch_path
    monkeypatch.setattr(json_schema, "scratch_path", lambda *a: folders.append(plain(*a)) or folders[-1])
    x = {"v": 9}
    for _ in range(7):
        x = {"v": 8, "next": x}
    df = spark.createDataFrame([(json.dumps(x),), ("{}",)], "j string")
    schema = {"properties": {"v": {"maximum": 7}, "next": {"$ref": "#"}}}
    (found,) = schema_violations(df, "j", schema).collect()
    assert len(found["_errors"]) == 8
    assert len(folders) <= 2


def test_values_of_a_level_are_parsed_once(spark):
    schema = {"properties": {"v": {"type": "integer", "maximum": 7, "minimum": 1, "multipleOf": 1}, "next": {"$ref": "#"}}}
    compiler = json_schema._Compiler(schema)
    compiler.errors(schema, json_schema._Spot(F.col("value"), F.lit("")), (("#", 0),))
    assert str(compiler.worked(F.col("error"))).count("parse_json") == 1
