"""One query per operator over the given tables, each with the SQL that has to agree with it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidegate.operators.sql import sql_transform
from tidegate.sources.tables import spread

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for steps that cost much per row."""
    return spread(table(spark, sf_dir, name))


def sql_query(
    name: str,
    sql: str,
    oracle: str | None = None,
    views: tuple[str, ...] = (),
    costly: bool = False,
) -> Query:
    """A query that runs SQL text over one registered table, and over ``views`` if given."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = {view: table(spark, sf_dir, view) for view in views}
        source = (spread_table if costly else table)(spark, sf_dir, name)
        return sql_transform(source, sql, views=more)

    return Query(build, (oracle or sql).replace("source_data", name))
