"""Named intermediate tables, kept as temporary views of the session."""

from pyspark.sql import DataFrame, SparkSession

MEMORY_SCHEME = "memory://"


def _view(key: str) -> str:
    return "named_" + key.removeprefix(MEMORY_SCHEME).strip("/").encode().hex()


def _key(view: str) -> str:
    return bytes.fromhex(view.removeprefix("named_")).decode()


def put_named(df: DataFrame, key: str, persist: bool = False) -> None:
    """Register ``df`` under ``key``, such as ``memory://stage/orders``."""
    (df.persist() if persist else df).createOrReplaceTempView(_view(key))


def get_named(spark: SparkSession, key: str) -> DataFrame:
    if not spark.catalog.tableExists(_view(key)):
        raise KeyError(f"No table named '{key}'.")
    return spark.table(_view(key))


def list_named(spark: SparkSession, prefix: str = "") -> list[str]:
    """Keys that start with ``prefix``."""
    start = prefix.removeprefix(MEMORY_SCHEME).lstrip("/")
    views = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith("named_")]
    return sorted(MEMORY_SCHEME + _key(view) for view in views if _key(view).startswith(start))


def clear_named(spark: SparkSession, prefix: str = "") -> int:
    """Drop the tables whose key starts with ``prefix``; returns how many there were."""
    keys = list_named(spark, prefix)
    for key in keys:
        spark.table(_view(key)).unpersist()
        spark.catalog.dropTempView(_view(key))
    return len(keys)
