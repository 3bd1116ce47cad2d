import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.errors import DataQualityError
from tidegate.functions.json_render import is_error_record, render_json
from tidegate.functions.json_text import parse_json_strict
from tidegate.functions.masking import MASK, mask_sensitive
from tidegate.operators.validate_json import (
    first_violation, gate_rows, ngsi_violations, schema_violations, with_ngsi_errors,
    with_schema_errors,
)

TEXTS = [
    '{"a":1}', '{"a":1} x', "1", "1.50", '"x"', "[1,2]", "null", "true", "", " ", '{"a":', "1 2",
    '1] , [2', '{"v":1} , "w":{}', '"a"b"', ' {"a": "é\\n"} ', '"a\nb"', "01", "1e3", "nul",
]


def is_json(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_strict_parse(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = dict(rows(df.select("t", F.to_json(parse_json_strict(F.col("t"))))))
    assert {t: v is not None for t, v in found.items()} == {t: is_json(t) for t in TEXTS}
    assert all(json.loads(v) == json.loads(t) for t, v in found.items() if v)


# A plain reading of the rules, as an oracle for the compiled form.


def kind_of(x):
    if x is None:
        return {"null"}
    if isinstance(x, bool):
        return {"boolean"}
    if isinstance(x, (int, float)):
        return {"number", "integer"} if x == int(x) else {"number"}
    return {str: {"string"}, list: {"array"}, dict: {"object"}}[type(x)]


CASES = [
    ({"type": "integer"}, [1, 1.0, 1.5, "1", True, None], [1, 1, 0, 0, 0, 0]),
    ({"type": "number"}, [1, 1.5, "1", None], [1, 1, 0, 0]),
    ({"type": ["string", "null"]}, ["", None, 0, []], [1, 1, 0, 0]),
    ({"type": "boolean"}, [True, 0, "true"], [1, 0, 0]),
    ({"enum": [1, "a", {"x": [1]}]}, [1, 1.0, "a", {"x": [1]}, {"x": [2]}, True], [1, 1, 1, 1, 0, 0]),
    ({"const": {"b": 1, "a": 2}}, [{"a": 2, "b": 1}, {"a": 2}], [1, 0]),
    ({"minimum": 2, "maximum": 5}, [1, 2, 5, 5.5, "9", 9007199254740993], [0, 1, 1, 0, 1, 0]),
    ({"minimum": 9007199254740993}, [9007199254740992, 9007199254740993], [0, 1]),
    ({"exclusiveMinimum": 2, "exclusiveMaximum": 5}, [2, 3, 5], [0, 1, 0]),
    ({"multipleOf": 3}, [9, 10, 4.5, 9.0, "x"], [1, 0, 0, 1, 1]),
    ({"multipleOf": 0.5}, [1.5, 1.2, 2], [1, 0, 1]),
    ({"minLength": 2, "maxLength": 3}, ["é", "éé", "abcd", 5], [0, 1, 0, 1]),
    ({"pattern": "b+$"}, ["abb", "bba", 1], [1, 0, 1]),
    ({"items": {"type": "integer"}}, [[1, 2], [1, "x"], [], "no"], [1, 0, 1, 1]),
    ({"items": [{"type": "integer"}, {"type": "string"}]}, [[1, "a", 3], [1], ["a"], []], [1, 1, 0, 1]),
    ({"items": [{}], "additionalItems": False}, [[1], [1, 2], []], [1, 0, 1]),
    ({"items": [{}], "additionalItems": {"type": "null"}}, [[1, None], [1, 2], []], [1, 0, 1]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[], [1], [1, 1], [1, 2, 3], [1, "1"]], [0, 1, 0, 0, 1]),
    ({"uniqueItems": True}, [[{"a": 1, "b": 2}, {"b": 2, "a": 1}], [[1], [2]]], [0, 1]),
    ({"contains": {"const": 3}}, [[1, 3], [1], [], 3], [1, 0, 0, 1]),
    ({"properties": {"a": {"type": "null"}}}, [{"a": None}, {"a": 1}, {}, [1]], [1, 0, 1, 1]),
    ({"required": ["a", "it's", "d.t", 'q"t']}, [{"a": 1, "it's": 2, "d.t": 3, 'q"t': 4}, {"a": None}, "x"], [1, 0, 1]),
    ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {"b": 1}, {}], [1, 0, 1]),
    ({"additionalProperties": {"type": "string"}}, [{"b": "x"}, {"b": 1}], [1, 0]),
    ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, [{"n_a": 1}, {"n_a": "x"}, {"z": 1}], [1, 0, 0]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, {"abc": 1}, 5], [1, 0, 1]),
    ({"minProperties": 1, "maxProperties": 1}, [{}, {"a": 1}, {"a": 1, "b": 2}], [0, 1, 0]),
    ({"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, [{"a": 1}, {"a": 1, "b": 1}, {"c": 1}, {"c": 1, "d": 1}, {}], [0, 1, 0, 1, 1]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 2, 4], [0, 1, 0]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 7, 3], [1, 1, 0]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 3, 6, 7], [1, 1, 0, 0]),
    ({"not": {"type": "string"}}, ["x", 1], [0, 1]),
    ({"if": {"type": "integer"}, "then": {"minimum": 5}, "else": {"type": "string"}}, [6, 4, "x", None], [1, 0, 1, 0]),
    ({"$ref": "#/definitions/p", "definitions": {"p": {"minimum": 3}}}, [3, 2], [1, 0]),
    ({"format": "email", "title": "t", "default": 1}, ["no mail"], [1]),
    (False, [1], [0]),
    (True, [1], [1]),
]


def test_schema_keywords(spark):
    for schema, values, expected in CASES:
        data = [(i, json.dumps(value)) for i, value in enumerate(values)]
        df = spark.createDataFrame(data, "i int, j string")
        checked = with_schema_errors(df, "j", json.dumps(schema)).orderBy("i").collect()
        assert [int(not r["_errors"]) for r in checked] == expected, (schema, checked)


def test_schema_messages(spark):
    schema = {
        "type": "object",
        "required": ["k"],
        "properties": {
            "k": {"type": "integer", "maximum": 50},
            "b": {"properties": {"c": {"items": {"type": "integer"}, "maxItems": 1}}},
        },
        "additionalProperties": False,
    }
    data = ['{"k":60}', '{"b":{"c":[1,"x"]},"zz":1}', "[]", "{", None]
    df = spark.createDataFrame(list(enumerate(data)), "i int, j string")
    found = {r.i: r["_errors"] for r in schema_violations(df, "j", schema).collect()}
    assert found == {
        0: ["k: 60 is greater than the maximum of 50"],
        1: [
            ": 'k' is a required property",
            ": Additional properties are not allowed ('zz' was unexpected)",
            'b/c: [1,"x"] is too long',
            "b/c/1: 'x' is not of type 'integer'",
        ],
        2: [": [] is not of type 'object'"],
        3: ["Invalid JSON string."],
        4: [": None is not of type 'object'"],
    }
    with pytest.raises(DataQualityError, match="for 5 records"):
        gate_rows(df, schema_violations(df, "j", schema), "JSON Schema validation failed")


def test_schema_on_nested_and_plain_columns(spark):
    df = spark.sql(
        "select named_struct('k', 1, 'z', cast(null as string)) as s, 7L as n, parse_json('{\"k\":1}') as v,"
        " map('k', 2) as m, cast('NaN' as double) as x"
    )
    nullable = {"required": ["k", "z"], "properties": {"z": {"type": "null"}, "k": {"type": "integer"}}}
    assert schema_violations(df, "s", nullable).count() == 0
    assert schema_violations(df, "n", {"type": "integer", "minimum": 8}).count() == 1
    assert schema_violations(df, "v", {"required": ["k"]}).count() == 0
    assert schema_violations(df, "m", {"properties": {"k": {"maximum": 1}}}).count() == 1
    assert schema_violations(df, "x", {"type": "null"}).count() == 0


def test_schema_refuses_what_it_cannot_check(spark):
    df = spark.createDataFrame([("1",)], "j string")
    loop = {"$ref": "#/definitions/a", "definitions": {"a": {"not": {"$ref": "#/definitions/a"}}}}
    for schema in ({"sparkles": 1}, loop, {"$ref": "http://x/y"}, {"type": "int"}):
        with pytest.raises(ValueError):
            with_schema_errors(df, "j", schema)
    with pytest.raises(KeyError):
        with_schema_errors(df, "nope", {})


ENTITIES = [
    '{"id":"x","type":"T","p":{"type":"Property","value":null},"@context":[]}',
    '{"id":"x","p":3,"r":{"type":"Relationship","value":1},"q":{"type":"Foo"}}',
    "[1]",
    "  ",
    "{bad",
    '{"id":"a","type":"b","s":{"type":5,"value":1},"g":{"type":"GeoProperty","value":{}}}',
    '{"id":"a","type":"b","r":{"type":"Relationship","object":null},"t":{"value":1}}',
]


def test_ngsi(spark):
    df = spark.createDataFrame(list(enumerate(ENTITIES)), "i int, value string")
    ld = [r["_errors"] for r in with_ngsi_errors(df).orderBy("i").collect()]
    assert ld == [
        [],
        [
            "Missing 'type'.",
            "Attribute 'p' must be a dictionary.",
            "NGSI-LD attribute 'q' has invalid 'type'.",
            "NGSI-LD attribute 'q' missing 'value'.",
            "NGSI-LD attribute 'r' missing 'object'.",
        ],
        ["Entity must be a JSON object."],
        [],
        ["Invalid JSON format."],
        ["NGSI-LD attribute 's' has invalid 'type'."],
        ["NGSI-LD attribute 't' has invalid 'type'."],
    ]
    v2 = [r["_errors"] for r in with_ngsi_errors(df, ngsi_version="V2").orderBy("i").collect()]
    assert v2[0] == ["Attribute '@context' must be a dictionary."]
    assert v2[1] == [
        "Missing 'type'.", "Attribute 'p' must be a dictionary.", "NGSI-v2 attribute 'q' missing 'value'.",
    ]
    assert v2[5] == []
    assert v2[6] == ["NGSI-v2 attribute 'r' missing 'value'.", "NGSI-v2 attribute 't' missing 'type'."]
    first = first_violation(ngsi_violations(df), "i").first()
    assert (first.i, first["_errors"]) == (1, ld[1])
    with pytest.raises(ValueError):
        with_ngsi_errors(df, ngsi_version="v3")


TEMPLATE = """{# a comment #}
{
    "id": "urn:gadget:{{ gadget }}",
    "warmth": {"type": "Property", "value": {{ warmth }}, "at": "{{ seen_at }}"},
    "place": {"coordinates": [ {{ east }}, {{north}} ], "fixed": [1, "a", null, true]},
    "empty": {}, "none": [],
    "@context": ["https://one.example/context", "two"]
}"""
GADGETS = "gadget string, warmth double, east double, north double, seen_at string"


def expected_entity(device, warmth, east, north, at):
    return {
        "id": f"urn:gadget:{device}",
        "warmth": {"type": "Property", "value": warmth, "at": at},
        "place": {"coordinates": [east, north], "fixed": [1, "a", None, True]},
        "empty": {},
        "none": [],
        "@context": ["https://one.example/context", "two"],
    }


def test_render(spark):
    data = [("G-1", 19.5, 2.35, 48.85, "2024-01-02T03:04:05Z"), ("日本", 1e10, -74.0, 0.0, "x")]
    found = [r.json for r in render_json(spark.createDataFrame(data, GADGETS), TEMPLATE).collect()]
    assert [json.loads(text) for text in found] == [expected_entity(*row) for row in data]
    assert list(json.loads(found[0])) == list(expected_entity(*data[0]))


def test_render_errors(spark):
    data = [
        ("a", None, 1.0, 1.0, "t"),
        ("a", float("nan"), 1.0, 1.0, "t"),
        ('say "x"', 1.0, 1.0, 1.0, "t"),
        ("a", 1.0, 1.0, 1.0, None),
        ("tab\\tA", 1.0, 1.0, 1.0, "two\nlines"),
        ("esc\\tA", 1.0, 1.0, 1.0, "t"),
    ]
    df = render_json(spark.createDataFrame(data, GADGETS), TEMPLATE, keep=["gadget"])
    found = df.select("*", is_error_record(F.col("json")).alias("bad")).collect()
    assert [r.bad for r in found] == [True, True, True, False, True, False]
    record = json.loads(found[2].json)
    assert record["error"] == "Slot 'gadget' breaks the JSON string."
    assert record["source_record"]["gadget"] == 'say "x"'
    assert json.loads(found[0].json)["source_record"]["warmth"] is None
    assert json.loads(found[3].json)["warmth"]["at"] == "None"
    assert json.loads(found[5].json)["id"].endswith("esc\tA")


def test_render_slots_of_other_types(spark):
    df = spark.sql("select '[1, {\"b\": 2}]' as j, true as ok, 'Ab' as s, cast(1.50 as decimal(5,2)) as d, 7 as n")
    template = '{"j": {{ j }}, "ok": {{ ok | lower }}, "s": {{ s|tojson }}, "d": {{ d }}, "t": "{{ s | upper }}-{{ n }}-{{ ok }}"}'
    record = json.loads(render_json(df, template).first().json)
    assert record == {"j": [1, {"b": 2}], "ok": True, "s": "Ab", "d": 1.5, "t": "AB-7-True"}
    bad = json.loads(render_json(df, '{"ok": {{ ok }}, "s": {{ s }}}').first().json)
    assert bad["error"] == "Slot 'ok' is not valid JSON."
    assert json.loads(render_json(df, "[{{ n }}, {{ s | tojson }}]").first().json) == [7, "Ab"]
    assert json.loads(render_json(df, "{{ n }}").first().json) == 7


def test_render_refuses(spark):
    df = spark.createDataFrame([("a",)], "s string")
    for template, error in (
        ('{"a": {{ nope }}}', KeyError),
        ('{"a": {{ s | sparkle }}}', ValueError),
        ('{"a": {{ s + 1 }}}', ValueError),
        ("{% if s %}{}{% endif %}", ValueError),
        ('{"a": {{ s }}', ValueError),
        ('{"{{ s }}": 1}', ValueError),
    ):
        with pytest.raises(error):
            render_json(df, template)


def test_mask(spark):
    df = spark.sql(
        """select 'u' as user, 'p' as Password, 5 as `api-key-id`,
           named_struct('token', 1, 'note', 'n', 'deep', array(named_struct('client_secret', 's', 'ok', 1))) as conf,
           map('Authorization', 'x', 'plain', 'y') as headers,
           map('private-key', 1, 'size', 2) as numbers, cast(null as struct<secret:string>) as gone"""
    )
    row = mask_sensitive(df).first().asDict(recursive=True)
    assert row == {
        "user": "u", "Password": MASK, "api-key-id": MASK,
        "conf": {"token": MASK, "note": "n", "deep": [{"client_secret": MASK, "ok": 1}]},
        "headers": {"Authorization": MASK, "plain": "y"},
        "numbers": {"private-key": MASK, "size": "2"}, "gone": None,
    }


def test_render_filters(spark):
    df = spark.createDataFrame(
        [(2.345, "5.9", None, ("x-y", 7), '{"b":1.50, "a":2}'), (None, "no", "t", ("p", None), "[ ]")],
        "d double, s string, n string, r struct<a:string,k:int>, j string",
    )
    template = """{"d": {{ d | default(0) | round(1) }}, "i": {{ s | int }}, "f": {{ s | float }}, "j": {{ j }},
        "t": "{{ n | default('none') | upper }}/{{ r.a | replace('-', '+') }}", "k": {{ r.k | default(-1) }}}"""
    found = [r.json for r in render_json(df, template).collect()]
    assert found == [
        '{"d":2.3,"i":5,"f":5.9,"j":{"b":1.50, "a":2},"t":"NONE/x+y","k":7}',
        '{"d":0.0,"i":0,"f":0.0,"j":[ ],"t":"T/p","k":-1}',
    ]
    for wrong in ("{{ d | nothing }}", "{{ d | round(x) }}", "{{ d + 1 }}"):
        with pytest.raises((ValueError, KeyError)):
            render_json(df, wrong)
