"""Duplicates and missing values."""

from pyspark.sql import functions as F

from conformance import Query, table
from tidegate.operators.dedupe import dedupe_report, drop_duplicates
from tidegate.operators.nulls import carry, drop_nulls, fill_nulls, null_census, null_report


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _gappy(spark, sf_dir):
    """Events whose reading is missing when they are errors, and whose type is missing when
    the reading is small."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("value") >= 5, F.col("event_type")).alias("event_type"),
    )


GAPPY = """(SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS value,
    CASE WHEN value >= 5 THEN event_type END AS event_type FROM events)"""


def _carried(method, **options):
    return lambda spark, sf_dir: carry(
        _gappy(spark, sf_dir), method, "event_id", ["value", "event_type"], **options
    )


def _carry_sql(function, frame, partition=""):
    window = f"({partition} ORDER BY event_id ROWS BETWEEN {frame})"
    return f"""SELECT event_id, user_id, {function}(value IGNORE NULLS) OVER {window} AS value,
        {function}(event_type IGNORE NULLS) OVER {window} AS event_type FROM {GAPPY}"""


BACK, AHEAD = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"

QUERIES = {
    "dedupe_first": Query(
        lambda s, d: drop_duplicates(_documents(s, d), ["text"], "first", "doc_id"),
        """SELECT * FROM documents
           QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    ),
    "dedupe_last": Query(
        lambda s, d: drop_duplicates(_documents(s, d), ["text"], "last", "doc_id"),
        """SELECT * FROM documents
           QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""",
    ),
    "dedupe_none": Query(
        lambda s, d: drop_duplicates(_documents(s, d), ["text"], False),
        "SELECT * FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1",
    ),
    "dedupe_all_columns": Query(
        lambda s, d: drop_duplicates(_documents(s, d).select("text", "lang", "source")),
        "SELECT DISTINCT text, lang, source FROM documents",
    ),
    "dedupe_missing_keys": Query(
        lambda s, d: drop_duplicates(_gappy(s, d), ["value", "event_type"], "first", "event_id"),
        f"""SELECT * FROM {GAPPY}
            QUALIFY row_number() OVER (PARTITION BY value, event_type ORDER BY event_id) = 1""",
    ),
    "dedupe_report": Query(
        lambda s, d: dedupe_report(_documents(s, d), ["text"]),
        """SELECT count(*) AS initial_rows, count(DISTINCT text) AS final_rows,
               count(*) - count(DISTINCT text) AS rows_removed FROM documents""",
    ),
    "null_drop_any": Query(
        lambda s, d: drop_nulls(_gappy(s, d)),
        f"SELECT * FROM {GAPPY} WHERE value IS NOT NULL AND event_type IS NOT NULL",
    ),
    "null_drop_subset": Query(
        lambda s, d: drop_nulls(_gappy(s, d), ["value"]),
        f"SELECT * FROM {GAPPY} WHERE value IS NOT NULL",
    ),
    "null_fill_scalar": Query(
        lambda s, d: fill_nulls(_gappy(s, d), "none"),
        f"SELECT event_id, user_id, value, coalesce(event_type, 'none') AS event_type FROM {GAPPY}",
    ),
    "null_fill_dict": Query(
        lambda s, d: fill_nulls(_gappy(s, d), {"value": -1, "event_type": "none"}),
        f"""SELECT event_id, user_id, coalesce(value, -1) AS value,
                coalesce(event_type, 'none') AS event_type FROM {GAPPY}""",
    ),
    "null_ffill": Query(_carried("ffill"), _carry_sql("last_value", BACK)),
    "null_bfill": Query(_carried("bfill"), _carry_sql("first_value", AHEAD)),
    "null_ffill_by_user": Query(
        _carried("ffill", partition_by=["user_id"]),
        _carry_sql("last_value", BACK, "PARTITION BY user_id"),
    ),
    # Every user counts as a heavy group, so all of them are cut into ranges.
    "null_ffill_heavy_users": Query(
        _carried("ffill", partition_by=["user_id"], hot_rows=20, buckets=8),
        _carry_sql("last_value", BACK, "PARTITION BY user_id"),
    ),
    "null_census": Query(
        lambda s, d: null_census(_gappy(s, d)),
        f"""SELECT 'event_id' AS "column", 0::BIGINT AS nulls
            UNION ALL SELECT 'user_id', 0
            UNION ALL SELECT 'value', count(*) - count(value) FROM {GAPPY}
            UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM {GAPPY}""",
    ),
    "null_report": Query(
        lambda s, d: null_report(_gappy(s, d), drop_nulls(_gappy(s, d), ["value"])),
        f"""SELECT CAST(sum((value IS NULL)::INT + (event_type IS NULL)::INT) AS BIGINT) AS initial_nulls,
                count(*) FILTER (value IS NOT NULL AND event_type IS NULL) AS final_nulls FROM {GAPPY}""",
    ),
}
