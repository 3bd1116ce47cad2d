"""Chains and graphs of steps, run reports, masking, named tables, streams, delivery."""

import re
from collections import Counter

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conformance import Query, spread_table, table
from conformance.cleansing import GAPPY, _gappy
from conformance.json_queries import ENTITY, ENTITY_SQL
from tidegate.errors import DataQualityError
from tidegate.functions.masking import mask_sensitive
from tidegate.operators.deliver import deliver, delivery_gate
from tidegate.operators.nulls import drop_nulls, fill_nulls
from tidegate.operators.quality import gate, quality_report
from tidegate.plans.metrics import observed, observed_report, run_report
from tidegate.plans.steps import run_graph, run_steps
from tidegate.scratch import scratch_path
from tidegate.sources.files import write_files
from tidegate.sources.named import clear_named, get_named, put_named
from tidegate.sources.tables import write_table
from tidegate.streaming.bodies import ingest_bodies
from tidegate.streaming.ingest import BODY, ingest, ingest_batches, read_landing

CHAIN = [
    {"plugin": "with_duckdb", "params": {
        "query": "SELECT event_id, user_id, event_type, value, props FROM source_data WHERE value > 0;"}},
    {"plugin": "duplicate_remover", "params": {"subset": ["event_id"], "order_by": "event_id"}},
    {"plugin": "data_quality", "params": {"rules": [
        {"column": "event_id", "type": "not_null"},
        {"column": "value", "type": "in_range", "min": 0}]}},
    {"plugin": "with_jinja2", "params": {"template": ENTITY}},
]


def _chain(spark, sf_dir):
    return run_steps(spark, CHAIN, spread_table(spark, sf_dir, "events"), write="none").result


def _graph(spark, sf_dir):
    """One cleaned table, used by two summaries that are written and read back."""
    a, b = scratch_path(spark, "by-status") + ".parquet", scratch_path(spark, "by-priority") + ".csv"
    nodes = [
        {"id": "priority", "plugin": "with_spark", "params": {"output_path": b, "query":
            "SELECT o_orderpriority AS k, count(*) AS n FROM source_data GROUP BY o_orderpriority"}},
        {"id": "status", "plugin": "with_spark", "params": {"output_path": a, "query":
            "SELECT o_orderstatus AS k, count(*) AS n FROM source_data GROUP BY o_orderstatus"}},
        {"id": "clean", "plugin": "null_handler", "params": {"strategy": "drop_row"}},
        {"id": "load", "plugin": "large_orders"},
    ]
    edges = [("load", "clean"), ("clean", "status"), ("clean", "priority")]
    spec = {"nodes": nodes, "edges": [{"source_node_id": s, "target_node_id": t} for s, t in edges]}
    own = {"large_orders": lambda df: df.where("o_totalprice > 100000")}
    run = run_graph(spark, spec, table(spark, sf_dir, "orders"), own)
    summaries = [
        spark.read.parquet(run.written["status"]),
        spark.read.csv(run.written["priority"], header=True, schema="k string, n long"),
    ]
    return summaries[0].union(summaries[1])


def _run_report(spark, sf_dir):
    events = _gappy(spark, sf_dir)
    dropped = drop_nulls(events, ["event_type"])
    filled = fill_nulls(dropped, {"value": 0.0})
    return run_report([("1", "read", events), ("2", "drop_row", dropped), ("3", "fill", filled)])


def _observed(spark, sf_dir):
    """Counts that fall out of a job that writes a table."""
    events, read = observed(_gappy(spark, sf_dir), "read")
    kept, dropped = observed(drop_nulls(events, ["event_type"]), "dropped")
    kept.write.parquet(scratch_path(spark, "observed"))
    return observed_report(spark, [("1", "read", read), ("2", "drop_row", dropped)])


def _masked(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("api_key"),
        F.struct("c_nationkey", F.col("c_acctbal").alias("Secret-Balance")).alias("account"),
        F.create_map(F.lit("auth_token"), "c_name", F.lit("segment"), "c_mktsegment").alias("headers"),
    )
    return mask_sensitive(customers).select(
        "c_custkey", "api_key", "account.c_nationkey", F.col("account.Secret-Balance").alias("balance"),
        F.col("headers")["auth_token"].alias("token"), F.col("headers")["segment"].alias("segment"),
    )


def _named(spark, sf_dir):
    put_named(table(spark, sf_dir, "supplier"), "memory://stage/supplier.parquet")
    suppliers = get_named(spark, "memory://stage/supplier.parquet")
    clear_named(spark, "memory://stage/")
    return suppliers.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))


def _landed(spark, sf_dir):
    """Events as JSON Lines files in a landing folder."""
    landing = scratch_path(spark, "landing")
    events = spread_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.write.option("ignoreNullFields", False).json(landing)
    return read_landing(spark, landing, "jsonl", events.schema, max_bytes_per_batch=4 << 20)


def _stream(spark, sf_dir):
    target = scratch_path(spark, "stream-out")
    steps = [
        {"plugin": "with_spark", "params": {
            "query": "SELECT event_id, upper(event_type) AS kind, value FROM source_data WHERE value > 10"}},
        {"plugin": "null_handler", "params": {"strategy": "fill", "value": "none"}},
    ]
    ingest(_landed(spark, sf_dir), steps, target, scratch_path(spark, "stream-log")).awaitTermination()
    return spark.read.parquet(target)


def _stream_batches(spark, sf_dir):
    """Duplicates are dropped within each batch, then over all batches."""
    target = scratch_path(spark, "batches-out")
    steps = [{"plugin": "duplicate_remover", "params": {"subset": ["user_id", "event_type"], "order_by": "event_id"}}]
    query = ingest_batches(_landed(spark, sf_dir), steps, target, scratch_path(spark, "batches-log"))
    query.awaitTermination()
    first = run_steps(spark, steps, spark.read.parquet(target), write="none").result
    return first.select("user_id", "event_type", "event_id", "value")


def _stream_report(spark, sf_dir):
    target = scratch_path(spark, "report-out")
    steps = [{"plugin": "business_rules", "params": {"rules": [{"name": "negative", "expression": "value < 0"}]}}]
    query = ingest_batches(_landed(spark, sf_dir), steps, target, scratch_path(spark, "report-log"))
    query.awaitTermination()
    reports = spark.read.parquet(target + ".reports")
    return reports.groupBy("status").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"))


def _skipped(spark, sf_dir):
    """Batches of one event type each; the gate refuses some, and their message says why."""
    landing, target = scratch_path(spark, "typed-landing"), scratch_path(spark, "skip-out")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.withColumn("kind", F.col("event_type")).repartition("kind").write.partitionBy("kind").json(landing)
    schema = "event_id long, user_id long, value double, event_type string"
    stream = read_landing(spark, landing, "jsonl", schema, max_bytes_per_batch=1)
    rule = {"column": "event_type", "type": "in_set", "values": ["click", "view", "purchase"]}
    steps = [{"plugin": "data_quality", "params": {"rules": [rule]}}]
    log = scratch_path(spark, "skip-log")
    ingest_batches(stream, steps, target, log, on_error="skip").awaitTermination()
    reports = spark.read.parquet(target + ".reports")
    reason = F.element_at(F.split("message", "\n"), -1).alias("reason")
    return reports.groupBy("status", reason).agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"))


def _bodies(spark, sf_dir):
    """Landed files of 500 events each in one batch; two gates judge each file by itself."""
    landing, target = scratch_path(spark, "bodies-landing"), scratch_path(spark, "bodies-out")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    one = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    files = events.groupBy(F.floor(F.col("event_id") / 500).alias("part")).agg(
        F.encode(F.array_join(F.collect_list(one), "\n"), "UTF-8").alias("content")
    )
    write_files(files.select(F.concat("part", F.lit(".jsonl")).alias("path"), "content"), landing)
    steps = [
        {"plugin": "duplicate_remover", "params": {"subset": ["user_id"], "order_by": "event_id"}},
        {"plugin": "data_quality", "params": {"rules": [
            {"column": "event_id", "type": "is_unique"}, {"column": "value", "type": "in_range", "max": 300}]}},
        {"plugin": "business_rules", "params": {"rules": [{"name": "late", "expression": "event_id % 1000 = 999"}]}},
    ]
    stream = read_landing(spark, landing, "jsonl", events.schema, on_malformed="mark")
    ingest_bodies(stream, steps, target, scratch_path(spark, "bodies-log")).awaitTermination()
    part = F.regexp_extract(BODY, r"(\d+)\.jsonl$", 1).cast("long").alias("part")
    reports = spark.read.parquet(target + ".reports")
    return reports.select(part, "status", "step", "message", "rows_in", "rows_out")


BODIES_SQL = """
WITH e AS (SELECT *, event_id // 500 AS part FROM events),
first AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY part, user_id ORDER BY event_id) = 1),
judged AS (
    SELECT part, count(*) AS kept, count(*) FILTER (value > 300) AS high,
        count(*) FILTER (event_id % 1000 = 999) AS late FROM first GROUP BY part),
landed AS (SELECT part, count(*) AS rows_in FROM e GROUP BY part)
SELECT part, CASE WHEN high + late > 0 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN high > 0 THEN 'data_quality' WHEN late > 0 THEN 'business_rules' END AS step,
    CASE WHEN high > 0 THEN 'Data quality validation failed:' || chr(10) || '- Column ''value'' has values out of range.'
         WHEN late > 0 THEN 'Business rule validation failed:' || chr(10) || '- Rule ''late'' failed for ' || late
             || ' rows. (Expression: ''event_id % 1000 = 999'').' END AS message,
    rows_in, CASE WHEN high + late > 0 THEN 0 ELSE kept END AS rows_out
FROM judged JOIN landed USING (part)
"""


def _gate_fails(spark, sf_dir):
    """What a gate says about the rules that fail."""
    lines = table(spark, sf_dir, "lineitem")
    rules = [
        {"column": "l_orderkey", "type": "not_null"},
        {"column": "l_orderkey", "type": "is_unique"},
        {"column": "l_quantity", "type": "in_range", "max": 10},
    ]
    try:
        gate(lines, quality_report(lines, rules))
        message = "passed"
    except DataQualityError as error:
        message = str(error)
    return lines.agg(F.count("*").alias("rows"), F.lit(message).alias("message"))


def _bad_cells(spark, sf_dir):
    """Whether a stream of tables refuses a cell that is no number; the good files arrive."""
    outcomes = []
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    for bad in (False, True):
        landing, target = scratch_path(spark, "cells"), scratch_path(spark, "cells-out")
        number = F.col("c_custkey").cast("string")
        cell = F.when(F.col("c_custkey") % 100 == 7, F.lit("seven")).otherwise(number) if bad else number
        write_table(customers.select(cell.alias("c_custkey"), "c_mktsegment"), landing, "csv")
        stream = read_landing(spark, landing, "csv", "c_custkey long, c_mktsegment string")
        keep = [{"plugin": "with_spark", "params": {"query": "SELECT * FROM source_data"}}]
        query = ingest(stream, keep, target, scratch_path(spark, "cells-log"))
        try:
            query.awaitTermination()
            found = spark.read.parquet(target).agg(F.sum("c_custkey").alias("total"))
            outcomes.append(found.select(F.lit("read").alias("outcome"), "total"))
        except StreamingQueryException:
            outcomes.append(spark.range(1).select(F.lit("refused").alias("outcome"), F.lit(None).cast("long").alias("total")))
    return outcomes[0].union(outcomes[1])


def _resumed(spark, sf_dir):
    """Requests that failed are sent again, and the gate is content then."""
    payload = F.to_json(F.struct("event_id", "event_type")).alias("payload")
    events = table(spark, sf_dir, "events").select("event_id", payload)
    path = scratch_path(spark, "resumed")
    deliver(events, "payload", _send, path, keep=["event_id"], key="event_id")
    healed = deliver(events, "payload", lambda payload, key: 200, path, keep=["event_id"], key="event_id", resume=True)
    return delivery_gate(healed).select("event_id", "status", "attempt")


def _send(payload: str, key: str) -> int:
    """A receiver that refuses errors and cannot be reached for views."""
    kind = re.search(r'"event_type":"(\w+)"', payload).group(1)
    if kind == "view":
        raise ConnectionError("unreachable")
    return 422 if kind == "error" else 201


class _Busy:
    """A receiver that is busy at the first request of a view, and at the first two of an error."""

    def __init__(self):
        self.seen = Counter()

    def __call__(self, payload: str, key: str) -> int:
        kind = re.search(r'"event_type":"(\w+)"', payload).group(1)
        self.seen[key] += 1
        return 503 if self.seen[key] <= {"view": 1, "error": 2}.get(kind, 0) else 201


def _retried(spark, sf_dir):
    """One more try reaches a receiver that was busy once; windows of several requests a task."""
    payload = F.to_json(F.struct("event_id", "event_type")).alias("payload")
    events = table(spark, sf_dir, "events").select("event_id", payload)
    sent = deliver(
        events, "payload", _Busy(), scratch_path(spark, "retried"), 64, ["event_id"], "event_id", retries=1, backoff=0.001
    )
    return sent.select("event_id", "status", "tries", "error")


def _delivered(spark, sf_dir):
    payload = F.to_json(F.struct("event_id", "event_type")).alias("payload")
    events = table(spark, sf_dir, "events").select("event_id", payload)
    sent = deliver(events, "payload", _send, scratch_path(spark, "delivery"), keep=["event_id"])
    return delivery_gate(sent, stop_on_fail=False).select("event_id", "status", "error")


QUERIES = {
    "step_chain": Query(_chain, f"SELECT {ENTITY_SQL} AS value FROM events WHERE value > 0"),
    "step_graph": Query(
        _graph,
        """SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1
           UNION ALL
           SELECT o_orderpriority, count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY 1""",
    ),
    "run_metrics": Query(
        _run_report,
        f"""WITH e AS (SELECT * FROM {GAPPY}), k AS (SELECT * FROM e WHERE event_type IS NOT NULL)
            SELECT '1' AS step, 'read' AS op, 'rows' AS metric, count(*) AS value FROM e
            UNION ALL SELECT '1', 'read', 'nulls', 2 * count(*) - count(value) - count(event_type) FROM e
            UNION ALL SELECT '2', 'drop_row', 'rows', count(*) FROM k
            UNION ALL SELECT '2', 'drop_row', 'nulls', count(*) - count(value) FROM k
            UNION ALL SELECT '3', 'fill', 'rows', count(*) FROM k
            UNION ALL SELECT '3', 'fill', 'nulls', 0""",
    ),
    "run_metrics_observed": Query(
        _observed,
        f"""WITH e AS (SELECT * FROM {GAPPY}), k AS (SELECT * FROM e WHERE event_type IS NOT NULL)
            SELECT '1' AS step, 'read' AS op, 'rows' AS metric, count(*) AS value FROM e
            UNION ALL SELECT '1', 'read', 'nulls', 2 * count(*) - count(value) - count(event_type) FROM e
            UNION ALL SELECT '2', 'drop_row', 'rows', count(*) FROM k
            UNION ALL SELECT '2', 'drop_row', 'nulls', count(*) - count(value) FROM k""",
    ),
    "mask_columns": Query(
        _masked,
        """SELECT c_custkey, '***REDACTED***' AS api_key, c_nationkey, '***REDACTED***' AS balance,
               '***REDACTED***' AS token, c_mktsegment AS segment FROM customer""",
    ),
    "named_tables": Query(_named, "SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey"),
    "stream_ingest": Query(
        _stream, "SELECT event_id, upper(event_type) AS kind, value FROM events WHERE value > 10"
    ),
    "stream_batch_dedupe": Query(
        _stream_batches,
        """SELECT user_id, event_type, event_id, value FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
    ),
    "stream_report": Query(
        _stream_report, "SELECT 'ok' AS status, count(*) AS rows_in, count(*) AS rows_out FROM events"
    ),
    "stream_skip_gate": Query(
        _skipped,
        """SELECT CASE WHEN good THEN 'ok' ELSE 'error' END AS status,
               CASE WHEN NOT good THEN '- Column ''event_type'' has values not in allowed set.' END AS reason,
               count(*) AS rows_in, count(*) FILTER (good) AS rows_out
           FROM (SELECT event_type IN ('click', 'view', 'purchase') AS good FROM events) GROUP BY good""",
    ),
    "stream_bodies": Query(_bodies, BODIES_SQL),
    "stream_bad_cells": Query(
        _bad_cells,
        """SELECT 'read' AS outcome, sum(c_custkey)::BIGINT AS total FROM customer
           UNION ALL SELECT 'refused', NULL""",
    ),
    "dq_gate_fails": Query(
        _gate_fails,
        """SELECT count(*) AS rows, 'Data quality validation failed:' || chr(10)
               || '- Column ''l_orderkey'' has duplicates.' || chr(10)
               || '- Column ''l_quantity'' has values out of range.' AS message FROM lineitem""",
    ),
    "deliver_resume": Query(
        _resumed,
        """SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 200 ELSE 201 END AS status,
               CASE WHEN event_type IN ('view', 'error') THEN 2 ELSE 1 END AS attempt FROM events""",
    ),
    "deliver_retry": Query(
        _retried,
        """SELECT event_id, CASE event_type WHEN 'error' THEN 503 ELSE 201 END AS status,
               CASE WHEN event_type IN ('view', 'error') THEN 2 ELSE 1 END AS tries,
               CASE event_type WHEN 'error' THEN 'HTTP status 503' END AS error FROM events""",
    ),
    "deliver_status": Query(
        _delivered,
        """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 422 ELSE 201 END AS status,
               CASE event_type WHEN 'view' THEN 'ConnectionError: unreachable'
                   WHEN 'error' THEN 'HTTP status 422' END AS error FROM events""",
    ),
}
