"""Rows to JSON, and validators over JSON."""

from pyspark.sql import functions as F

from conformance import Query, spread_table
from tidegate.functions.json_render import render_json
from tidegate.operators.validate_json import (
    first_violation, gate_rows, ngsi_violations, schema_violations, with_ngsi_errors,
)

ENTITY = """{# one reading #}
{
    "id": "urn:ngsi-ld:Event:{{ event_id }}",
    "type": "Event",
    "kind": {"type": "Property", "value": "{{ event_type }}"},
    "reading": {"type": "Property", "value": {{ value }}, "user": {{ user_id }}},
    "props": {{ props }},
    "@context": ["https://uri.etsi.org/ngsi-ld/v1/ngsi-ld-core-context.jsonld"]
}"""
ENTITY_SQL = """replace(CAST(to_json({'id': 'urn:ngsi-ld:Event:' || event_id, 'type': 'Event',
    'kind': {'type': 'Property', 'value': event_type},
    'reading': {'type': 'Property', 'value': value, 'user': user_id},
    'props': '@props@',
    '@context': ['https://uri.etsi.org/ngsi-ld/v1/ngsi-ld-core-context.jsonld']}) AS VARCHAR),
    '"@props@"', props)"""

MESSAGE = '{"conversation": {{ conv_id }}, "role": "{{ role }}", "text": {{ text | tojson }}}'


def _render(spark, sf_dir):
    return render_json(spread_table(spark, sf_dir, "events"), ENTITY, "entity", keep=["event_id"])


def _render_filters(spark, sf_dir):
    template = """{"id": {{ event_id }}, "kind": "{{ event_type | replace('e', '3') | upper }}",
        "value": {{ value | round(1) }}, "whole": {{ value | int }}, "far": "{{ far.kind | default('near') }}"}"""
    events = spread_table(spark, sf_dir, "events").withColumn(
        "far", F.struct(F.when(F.col("value") > 50, F.col("event_type")).alias("kind"))
    )
    made = render_json(events, template, "entity")
    fields = "id long, kind string, value double, whole long, far string"
    return made.select(F.from_json("entity", fields).alias("e")).select("e.*")


def _render_text(spark, sf_dir):
    df = render_json(spread_table(spark, sf_dir, "conversations"), MESSAGE, "message", keep=["conv_id", "turn"])
    # Read back, so that the texts are compared and not the way their characters are escaped.
    fields = F.from_json("message", "conversation long, role string, text string").alias("m")
    return df.select("conv_id", "turn", fields).select("conv_id", "turn", "m.*")


def _render_gaps(spark, sf_dir):
    df = spread_table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return render_json(df, '{"id": {{ event_id }}, "value": {{ value }}}', "entity", keep=["event_id"])


PROPS_SCHEMA = {
    "type": "object",
    "required": ["k"],
    "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 49}},
    "additionalProperties": False,
}
PART_SCHEMA = {
    "properties": {
        "name": {"type": "string", "pattern": "^(red|blue|small) ", "maxLength": 11},
        "size": {"multipleOf": 5, "exclusiveMaximum": 40},
        "tags": {"items": {"enum": ["ECONOMY", "SMALL", "Brand#1"]}, "uniqueItems": True},
    },
    "anyOf": [{"properties": {"size": {"minimum": 10}}}, {"required": ["extra"]}],
}


def _schema_props(spark, sf_dir):
    bad = schema_violations(spread_table(spark, sf_dir, "events"), "props", PROPS_SCHEMA)
    return bad.select("event_id", F.array_join("_errors", "; ").alias("errors"))


def _schema_nested(spark, sf_dir):
    parts = spread_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.struct(
            F.col("p_name").alias("name"),
            F.col("p_size").alias("size"),
            F.array("p_type", "p_brand").alias("tags"),
        ).alias("part"),
    )
    bad = schema_violations(parts, "part", PART_SCHEMA)
    return bad.select("p_partkey", F.size("_errors").cast("long").alias("n_errors"))


def _schema_gate(spark, sf_dir):
    events = spread_table(spark, sf_dir, "events")
    schema = {"required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0}}}
    return gate_rows(events, schema_violations(events, "props", schema), "JSON Schema validation failed")


def _entities(spark, sf_dir):
    """One entity text per event, with faults that depend on the row's values."""
    event = F.concat(
        F.lit('{"id":"e'), F.col("event_id").cast("string"), F.lit('"'),
        F.when(F.col("value") < 2, "").otherwise(',"type":"Event"'),
        F.lit(',"kind":'),
        F.when(F.col("event_type") == "click", F.lit('"click"'))
        .when(F.col("event_type") == "error", F.lit('{"type":"Fault","value":1}'))
        .when(F.col("event_type") == "view", F.lit('{"type":"Relationship","value":1}'))
        .otherwise('{"type":"Property","value":null}'),
        F.lit(',"props":'), F.col("props"),
        F.lit(',"@context":[]'),
        F.when(F.col("value") > 90, "").otherwise("}"),
    )
    return spread_table(spark, sf_dir, "events").select("event_id", event.alias("value"))


_NO_TYPE = "CASE WHEN value < 2 THEN 'Missing ''type''.' END"
_LD_ERRORS = f"""CASE WHEN value > 90 THEN 'Invalid JSON format.' ELSE concat_ws('; ', {_NO_TYPE},
    CASE event_type WHEN 'click' THEN 'Attribute ''kind'' must be a dictionary.'
        WHEN 'error' THEN 'NGSI-LD attribute ''kind'' has invalid ''type''.'
        WHEN 'view' THEN 'NGSI-LD attribute ''kind'' missing ''object''.' END,
    'NGSI-LD attribute ''props'' has invalid ''type''.',
    'NGSI-LD attribute ''props'' missing ''value''.') END"""
_V2_ERRORS = f"""CASE WHEN value > 90 THEN 'Invalid JSON format.' ELSE concat_ws('; ', {_NO_TYPE},
    'Attribute ''@context'' must be a dictionary.',
    CASE WHEN event_type = 'click' THEN 'Attribute ''kind'' must be a dictionary.' END,
    'NGSI-v2 attribute ''props'' missing ''type''.',
    'NGSI-v2 attribute ''props'' missing ''value''.') END"""


def _ngsi(version):
    def build(spark, sf_dir):
        bad = ngsi_violations(_entities(spark, sf_dir), ngsi_version=version)
        return bad.select("event_id", F.array_join("_errors", "; ").alias("errors"))

    return build


def _ngsi_counts(spark, sf_dir):
    marked = with_ngsi_errors(_entities(spark, sf_dir))
    errors = marked.select(F.explode("_errors").alias("error"))
    return errors.groupBy("error").agg(F.count("*").alias("lines"))


def _ngsi_first(spark, sf_dir):
    bad = ngsi_violations(_entities(spark, sf_dir))
    first = first_violation(bad, "event_id")
    return first.select("event_id", F.array_join("_errors", "; ").alias("errors"))


CHAIN_SCHEMA = {
    "type": "object",
    "properties": {"v": {"type": "integer", "maximum": 7}, "next": {"$ref": "#"}},
}


def _recursive_schema(spark, sf_dir):
    """The digits of each order's key as a list of objects within objects, of any depth."""
    digits = F.reverse(F.split(F.col("o_orderkey").cast("string"), ""))
    text = F.aggregate(digits, F.lit("{}"), lambda rest, d: F.concat(F.lit('{"v":'), d, F.lit(',"next":'), rest, F.lit("}")))
    orders = spread_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("chain"))
    bad = schema_violations(orders, "chain", CHAIN_SCHEMA)
    return bad.select("o_orderkey", F.array_join(F.sort_array("_errors"), "; ").alias("errors"))


CHAIN_SQL = """
WITH digits AS (SELECT o_orderkey, string_split(CAST(o_orderkey AS VARCHAR), '') AS d FROM orders),
found AS (
    SELECT o_orderkey, list_sort(list_transform(list_filter(range(1, len(d) + 1), lambda i: CAST(d[i] AS INT) > 7),
        lambda i: repeat('next/', i - 1) || 'v: ' || d[i] || ' is greater than the maximum of 7')) AS errors
    FROM digits)
SELECT o_orderkey, array_to_string(errors, '; ') AS errors FROM found WHERE len(errors) > 0
"""

QUERIES = {
    "render_json": Query(_render, f"SELECT event_id, {ENTITY_SQL} AS entity FROM events"),
    "render_json_filters": Query(
        _render_filters,
        """SELECT event_id AS id, upper(replace(event_type, 'e', '3')) AS kind, round(value, 1) AS value,
               trunc(value)::BIGINT AS whole, CASE WHEN value > 50 THEN event_type ELSE 'near' END AS far
           FROM events""",
    ),
    "render_json_text": Query(
        _render_text, "SELECT conv_id, turn, conv_id AS conversation, role, text FROM conversations"
    ),
    "render_json_errors": Query(
        _render_gaps,
        """SELECT event_id, CASE WHEN event_type <> 'error'
               THEN CAST(to_json({'id': event_id, 'value': value}) AS VARCHAR)
               ELSE CAST(to_json({'error': 'Slot ''value'' is missing.',
                   'source_record': {'event_id': event_id, 'value': CAST(NULL AS DOUBLE)}}) AS VARCHAR)
               END AS entity FROM events""",
    ),
    "jsonschema_recursive": Query(_recursive_schema, CHAIN_SQL),
    "jsonschema_violations": Query(
        _schema_props,
        """SELECT event_id, 'k: ' || k || ' is greater than the maximum of 49' AS errors
           FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
           WHERE k > 49""",
    ),
    "jsonschema_nested": Query(
        _schema_nested,
        """SELECT p_partkey, n_errors FROM (
               SELECT p_partkey, CAST(
                   (NOT regexp_matches(p_name, '^(red|blue|small) '))::INT + (length(p_name) > 11)::INT
                   + (p_size % 5 <> 0)::INT + (p_size >= 40)::INT
                   + (p_type NOT IN ('ECONOMY', 'SMALL'))::INT + (p_brand <> 'Brand#1')::INT
                   + (p_size < 10)::INT AS BIGINT) AS n_errors
               FROM part) WHERE n_errors > 0""",
    ),
    "jsonschema_gate": Query(_schema_gate, "SELECT * FROM events"),
    "ngsi_ld_report": Query(_ngsi("ld"), f"SELECT event_id, {_LD_ERRORS} AS errors FROM events"),
    "ngsi_v2_report": Query(_ngsi("v2"), f"SELECT event_id, {_V2_ERRORS} AS errors FROM events"),
    "ngsi_error_counts": Query(
        _ngsi_counts,
        f"""SELECT error, count(*) AS lines FROM
                (SELECT unnest(string_split({_LD_ERRORS}, '; ')) AS error FROM events) GROUP BY error""",
    ),
    "ngsi_first_error": Query(
        _ngsi_first, f"SELECT event_id, {_LD_ERRORS} AS errors FROM events ORDER BY event_id LIMIT 1"
    ),
}
