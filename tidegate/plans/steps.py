"""Steps: named table operators with parameters, chained or connected to a graph.

A run composes one lazy plan: a step gets the DataFrame of the step before it, not a file.
``input_path`` and ``output_path`` say where a table enters and leaves; an ``input_path`` that
an earlier step of the run writes stands for that step's DataFrame.
"""

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.errors import DataQualityError
from tidegate.functions.formats import format_from_path
from tidegate.functions.json_render import render_json
from tidegate.functions.missing import ORDER_COLUMN
from tidegate.operators import dedupe, deliver, file_jobs, nulls, quality, sql, validate_json
from tidegate.scratch import scratch_path
from tidegate.sources import named, tables, text
from tidegate.sources.files import file_catalog, read_files, write_files

Step = Callable[..., DataFrame]

# Parameters that say where a step reads and writes; the run handles them.
PATHS = ("input_path", "output_path", "input_encoding", "large_dataset")
_LINE_READERS = ("ngsi_validator", "to_http")
_FILE_READERS = ("encoding_converter", "format_detector", "archive_extractor")


def _sql_step(df, query_file=None, query=None, table_name="source_data"):
    if query is None:
        return sql.sql_transform_file(df, query_file, table_name)
    return sql.sql_transform(df, query, table_name)


def template_rows(df, template_path=None, template=None, keep=None):
    if template is None:
        with open(template_path, encoding="utf-8") as file:
            template = file.read()
    return render_json(df, template, "value", keep)


def _template_step(df, template_path=None, template=None):
    return template_rows(df, template_path, template)


def _quality_step(df, rules):
    return quality.gate(df, quality.quality_report(df, rules))


def _business_step(df, rules):
    report = quality.business_report(df, rules)
    return quality.gate(df, report, "Business rule validation failed")


def loaded_schema(schema_path=None, schema=None):
    if schema is None:
        with open(schema_path, encoding="utf-8") as file:
            schema = json.load(file)
    return schema


def _schema_step(df, target_column, schema_path=None, schema=None):
    bad = validate_json.schema_violations(df, target_column, loaded_schema(schema_path, schema))
    return validate_json.gate_rows(df, bad, "JSON Schema validation failed")


def _ngsi_step(df, ngsi_version="ld", stop_on_first_error=None, line_column="value"):
    """Reports the first error only, where rows have an order, unless all are asked for."""
    bad = validate_json.ngsi_violations(df, line_column, ngsi_version)
    ordered = ORDER_COLUMN in df.columns
    if stop_on_first_error or (stop_on_first_error is None and ordered):
        if not ordered:
            raise ValueError(
                "There is no order of rows to tell the first error by; read the lines from a file,"
                " or set stop_on_first_error to false to see all errors."
            )
        first = validate_json.first_violation(bad).collect()
        if first:
            raise DataQualityError("\n".join(first[0][validate_json.ERRORS]))
        return df
    return validate_json.gate_rows(df, bad, "NGSI validation failed")


def _http_step(df, url=None, method="POST", concurrency=10, headers=None, stop_on_fail=True,
               send=None, status_path=None, payload="value", key=None):
    sender = send or deliver.HttpSender(url, method, headers or {})
    path = status_path or scratch_path(df.sparkSession, "delivery")
    statuses = deliver.deliver(df, payload, sender, path, concurrency, key=key)
    return deliver.delivery_gate(statuses, stop_on_fail)


def _dedupe_step(df, subset=None, keep="first", order_by=None):
    return dedupe.drop_duplicates(df, subset, keep, order_by)


def _encoding_step(df, source_encoding=None, target_encoding="utf-8", encoding_detection_sample_size=None):
    """The sample size is taken and not needed: the charset is judged by the whole content."""
    return file_jobs.convert_encoding(df, source_encoding, target_encoding)


def _format_step(df, read_chunk_size=4096):
    return df.withColumn("detected_format", file_jobs.detect_format(F.col("content"), read_chunk_size))


def _archive_step(df, strip_components=0):
    """Members of the archives of a catalog; a bad archive fails the job that writes them."""
    return file_jobs.expand_archive_files(df, strip_components, strict=True)


# Step name -> operator.
STEPS: dict[str, Step] = {
    "with_duckdb": _sql_step,
    "with_spark": _sql_step,
    "with_jinja2": _template_step,
    "duplicate_remover": _dedupe_step,
    "null_handler": nulls.handle_nulls,
    "data_quality": _quality_step,
    "business_rules": _business_step,
    "json_schema": _schema_step,
    "ngsi_validator": _ngsi_step,
    "to_http": _http_step,
    "encoding_converter": _encoding_step,
    "format_detector": _format_step,
    "archive_extractor": _archive_step,
    "receive_http": lambda df: df,
}


def _step_function(plugin, own: dict[str, Step]) -> Step:
    if callable(plugin):
        return plugin
    if plugin in own:
        return own[plugin]
    if plugin not in STEPS:
        raise ValueError(f"Unknown step '{plugin}'.")
    return STEPS[plugin]


def _read_input(spark: SparkSession, plugin: str, params: dict) -> DataFrame:
    path = params["input_path"]
    if path.startswith(named.MEMORY_SCHEME):
        return named.get_named(spark, path)
    if plugin in _LINE_READERS:
        return text.read_lines(spark, path)
    if plugin == "archive_extractor":
        return file_catalog(spark, path)
    if plugin in _FILE_READERS:
        return read_files(spark, path)
    # Steps that depend on the order of rows get it from the file.
    ordered = plugin in ("duplicate_remover", "null_handler") and "order_by" not in params
    return tables.read_table(
        spark, path, encoding=params.get("input_encoding", "utf-8"), row_order=ordered
    )


def _holds_lines(df: DataFrame) -> bool:
    return df.drop(ORDER_COLUMN).dtypes == [("value", "string")]


def _hand_over(df: DataFrame, producer: str, plugin, path: str) -> DataFrame:
    """The output of an earlier step as the next one reads it from ``path``.

    JSON lines that a step for tables reads become columns, and these are known only once the
    lines are written.
    """
    makes_lines = producer in ("with_jinja2", "ngsi_validator") and _holds_lines(df)
    if not makes_lines or plugin in _LINE_READERS or plugin not in STEPS:
        return df
    text.write_lines(df, "value", path)
    return tables.read_table(df.sparkSession, path, "jsonl")


def _below(folder: str | None, path: str) -> Column:
    """A path relative to the folder that was read; the file's name if it was that file."""
    # Paths carry a scheme that the folder may lack, so the folder is looked for within them.
    root = (folder or "").rstrip("/").split("://")[-1]
    name = F.substring_index(path, "/", -1)
    if not root or root.startswith("file:"):
        root = root.removeprefix("file:")
    inside = F.instr(F.col(path), root + "/") if root else F.lit(0)
    return F.when(inside > 0, F.substring(F.col(path), inside + len(root) + 1, F.length(path))).otherwise(name)


def _write_output(df: DataFrame, plugin: str, path: str, source: str | None = None) -> None:
    if plugin in _FILE_READERS:
        # Files stay files: by their path below the folder that was read, members below the
        # path of their archive, so that files of one name do not meet.
        name = _below(source, "path" if "path" in df.columns else "archive")
        if "member" in df.columns:
            name = F.concat_ws("/", name, "member")
        content = "converted" if "converted" in df.columns else "content"
        write_files(df.select(name.alias("name"), content), path, "name", content)
    elif path.startswith(named.MEMORY_SCHEME):
        named.put_named(df, path)
    elif _holds_lines(df) and format_from_path(path) not in ("csv", "parquet"):
        text.write_lines(df, "value", path)
    else:
        tables.write_table(df, path)


@dataclass
class Run:
    """Outputs of a run by step, the order in which steps were planned, and what was written."""

    outputs: dict[str, DataFrame] = field(default_factory=dict)
    history: list[tuple[str, str]] = field(default_factory=list)
    written: dict[str, str] = field(default_factory=dict)

    @property
    def result(self) -> DataFrame:
        return self.outputs[self.history[-1][0]]


def _apply(spark, run: Run, step_id: str, step: dict, upstream: DataFrame | None, own, paths) -> DataFrame:
    plugin, params = step["plugin"], dict(step.get("params") or {})
    function = _step_function(plugin, own)
    df = upstream
    source = params.get("input_path")
    if source in paths:
        made = run.outputs[paths[source]]
        df = _hand_over(made, dict(run.history)[paths[source]], plugin, source)
        if df is not made:
            run.written[paths[source]] = source
    elif source is not None:
        df = _read_input(spark, plugin, params)
    if df is None:
        raise ValueError(f"Step '{step_id}' has no input: give it an upstream step or input_path.")
    arguments = {name: value for name, value in params.items() if name not in PATHS}
    output = function(df, **arguments)
    if not isinstance(output, DataFrame):
        raise TypeError(f"Step '{step_id}' returned {type(output).__name__}, not a DataFrame.")
    run.outputs[step_id] = output
    run.history.append((step_id, plugin if isinstance(plugin, str) else plugin.__name__))
    if params.get("output_path"):
        paths[params["output_path"]] = step_id
    return output


def run_steps(
    spark: SparkSession,
    steps: list[dict],
    df: DataFrame | None = None,
    own: dict[str, Step] | None = None,
    write: str = "all",
) -> Run:
    """Chain ``[{"plugin": ..., "params": {...}}]``: each step gets the output of the one before.

    ``write`` says which ``output_path`` are written: ``all``, ``last`` or ``none``.
    """
    if not steps:
        raise ValueError("steps is empty. At least one step is required.")
    nodes = [{"id": f"step_{i}", **step} for i, step in enumerate(steps)]
    edges = [
        {"source_node_id": a["id"], "target_node_id": b["id"]} for a, b in zip(nodes, nodes[1:])
    ]
    spec = {"nodes": nodes, "edges": edges}
    return run_graph(spark, spec, df, own, {"last": "sinks"}.get(write, write))


def check_graph(nodes: list[dict], edges: list[dict]) -> list[str]:
    """Check that the nodes form a forest of steps; returns their ids, upstream first."""
    if not nodes:
        raise ValueError("The graph must have at least one node.")
    ids = [node["id"] for node in nodes]
    repeated = sorted(node_id for node_id, n in Counter(ids).items() if n > 1)
    if repeated:
        raise ValueError(f"Duplicate node IDs: {repeated}")
    upstream: dict[str, str] = {}
    for edge in edges:
        source, target = edge["source_node_id"], edge["target_node_id"]
        for end in (source, target):
            if end not in ids:
                raise ValueError(f"An edge names the unknown node '{end}'.")
        if target in upstream:
            raise ValueError(f"Node '{target}' has more than one upstream node.")
        upstream[target] = source
    order: list[str] = []
    while len(order) < len(ids):
        ready = [i for i in ids if i not in order and (i not in upstream or upstream[i] in order)]
        if not ready:
            raise ValueError(f"The graph has a cycle: {sorted(set(ids) - set(order))}")
        order += ready
    return order


def run_graph(
    spark: SparkSession,
    spec: dict,
    df: DataFrame | None = None,
    own: dict[str, Step] | None = None,
    write: str = "all",
    share: str = "persist",
) -> Run:
    """Run ``{"nodes": [{id, plugin, params}], "edges": [{source_node_id, target_node_id}]}``.

    Each node is planned once and has at most one upstream node; ``df`` is the input of nodes
    without upstream and ``input_path``. ``write`` says which ``output_path`` are written:
    ``all``, ``sinks`` or ``none``. A node that is written and used is shared as well, so that
    it is computed once.

    ``share`` says what becomes of an output that several nodes use: ``persist`` keeps it in
    the executors while the sinks are written, ``write`` puts it in a table in the checkpoint
    folder, which also outlives lost executors, and ``recompute`` leaves it alone.
    """
    if write not in ("sinks", "all", "none"):
        raise ValueError(f"write must be 'sinks', 'all' or 'none', not {write!r}.")
    if share not in ("persist", "write", "recompute"):
        raise ValueError(f"share must be 'persist', 'write' or 'recompute', not {share!r}.")
    nodes = {node["id"]: node for node in spec["nodes"]}
    edges = spec.get("edges") or []
    order = check_graph(spec["nodes"], edges)
    upstream = {edge["target_node_id"]: edge["source_node_id"] for edge in edges}
    uses = Counter(upstream.values())
    if write == "all":
        named_outputs = [n for n in nodes if (nodes[n].get("params") or {}).get("output_path")]
        uses.update(n for n in named_outputs if uses[n])
    run, paths, kept = Run(), {}, []
    try:
        for node_id in order:
            source = run.outputs[upstream[node_id]] if node_id in upstream else df
            output = _apply(spark, run, node_id, nodes[node_id], source, own or {}, paths)
            if uses[node_id] > 1 and share == "write":
                path = scratch_path(spark, "shared")
                output.write.parquet(path)
                run.outputs[node_id] = spark.read.parquet(path)
            elif uses[node_id] > 1 and share == "persist" and write != "none":
                kept.append(output.persist())
        for node_id in order:
            path = (nodes[node_id].get("params") or {}).get("output_path")
            wanted = write == "all" or (write == "sinks" and not uses[node_id])
            if path and wanted and node_id not in run.written:
                source = (nodes[node_id].get("params") or {}).get("input_path")
                _write_output(run.outputs[node_id], nodes[node_id]["plugin"], path, source)
                run.written[node_id] = path
    finally:
        for output in kept:
            output.unpersist()
    return run
