"""SQL text over one registered table."""

from pyspark.sql import DataFrame, SparkSession


def _temporary_view(spark: SparkSession, name: str) -> DataFrame | None:
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
        return spark.table(name)
    return None


def _without_nested_loops(df: DataFrame) -> DataFrame:
    """The same rows, with correlated scalar subqueries joined by the hash of their keys.

    Where Spark cannot prove that a subquery gives one row at most, it compares every row of a large
    table with every row of the subquery, unless a hint says otherwise. Two rows still are an error.
    """
    plans = df._jdf.queryExecution()
    if df.isStreaming or "outer(" not in plans.analyzed().toString():
        return df
    looped = any("NestedLoopJoin" in x and "LeftSingle" in x for x in plans.executedPlan().toString().splitlines())
    if not looped:
        return df
    jvm = df.sparkSession._jvm
    logical = jvm.org.apache.spark.sql.catalyst.plans.logical
    by_hash = getattr(getattr(logical, "SHUFFLE_HASH$"), "MODULE$")
    hint = jvm.scala.Some(logical.HintInfo(jvm.scala.Some(by_hash)))

    def seq(items):
        return jvm.PythonUtils.toSeq(items)

    def with_children(node, change):
        before = [node.children().apply(i) for i in range(node.children().size())]
        after = [change(child) for child in before]
        return node if all(a is b for a, b in zip(before, after)) else node.withNewChildren(seq(after))

    def expression(node):
        name = node.getClass().getSimpleName()
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            inner = plan(node.plan())
            if name == "ScalarSubquery" and node.isCorrelated() and node.hint().isEmpty():
                return node.withNewHint(hint).withNewPlan(inner)
            return node.withNewPlan(inner)
        return with_children(node, expression)

    def plan(node):
        node = with_children(node, plan)
        name = node.getClass().getSimpleName()
        if name == "Filter":
            return logical.Filter(expression(node.condition()), node.child())
        if name == "Project":
            listed = node.projectList()
            return logical.Project(seq([expression(listed.apply(i)) for i in range(listed.size())]), node.child())
        return node

    rows = getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$")
    return DataFrame(rows.ofRows(df.sparkSession._jsparkSession, plan(plans.analyzed())), df.sparkSession)


def sql_transform(
    df: DataFrame,
    sql: str,
    table_name: str = "source_data",
    views: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Run one Spark SQL statement with ``df`` visible as ``table_name``.

    ``views`` makes further tables visible, for joins. The result keeps the tables it was
    planned with; temporary views of the same name are put back afterwards.
    """
    spark = df.sparkSession
    tables = {table_name: df, **(views or {})}
    before = {name: _temporary_view(spark, name) for name in tables}
    try:
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
        return _without_nested_loops(spark.sql(sql))
    finally:
        for name, table in before.items():
            spark.catalog.dropTempView(name)
            if table is not None:
                table.createOrReplaceTempView(name)


def sql_transform_file(df: DataFrame, query_file: str, table_name: str = "source_data") -> DataFrame:
    """:func:`sql_transform` with the statement read from a file."""
    with open(query_file, encoding="utf-8") as file:
        return sql_transform(df, file.read(), table_name)
