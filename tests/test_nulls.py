import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegate.operators import nulls
from tidegate.operators.nulls import (
    carry, drop_nulls, fill_nulls, fillable_columns, handle_nulls, null_census, null_report,
)

SCHEMA = "ord long, a double, b string, n long"
NAN = float("nan")


def random_rows(seed, n=300, gap=0.6):
    rng = random.Random(seed)

    def maybe(value):
        return value if rng.random() > gap else None

    data = [
        (i, rng.choice([maybe(rng.random()), NAN]), maybe(rng.choice("xyz")), maybe(rng.randrange(9)))
        for i in range(n)
    ]
    # Gaps at both ends and a long gap inside.
    for i in [*range(5), *range(100, 180), *range(n - 5, n)]:
        data[i] = (i, None, None, None)
    return data


def frame(data):
    df = pd.DataFrame(data, columns=["ord", "a", "b", "n"])
    return df.astype({"b": object, "n": "float64"})


def plain(df):
    return [
        tuple(None if v is None or v != v else v for v in row) for row in df.itertuples(index=False)
    ]


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_carry_matches_pandas(spark, method, buckets):
    data = random_rows(buckets)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = carry(df, method, "ord", buckets=buckets)
    expected = frame(data).ffill() if method == "ffill" else frame(data).bfill()
    assert rows(found, "ord") == plain(expected)


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_carry_by_group(spark, method, hot_rows):
    data = random_rows(11)
    df = spark.createDataFrame(data, SCHEMA).withColumn(
        "g", F.when(F.col("ord") % 3 == 0, None).when(F.col("ord") > 290, "small").otherwise("big")
    )
    found = carry(df, method, "ord", partition_by=["g"], buckets=6, hot_rows=hot_rows)
    pdf = frame(data)
    pdf["g"] = ["-" if i % 3 == 0 else "small" if i > 290 else "big" for i in pdf.ord]
    grouped = pdf.groupby("g")[["a", "b", "n"]]
    pdf[["a", "b", "n"]] = grouped.ffill() if method == "ffill" else grouped.bfill()
    assert rows(found.drop("g"), "ord") == plain(pdf.drop(columns="g"))


def test_carry_over_range_partitions(spark, monkeypatch):
    """A leading value that covers most rows is cut by the rest of the ordering key."""
    monkeypatch.setattr(nulls, "FEW_ROWS", 10)
    data = random_rows(5)
    df = spark.createDataFrame(data, SCHEMA).withColumn("day", (F.col("ord") > 250).cast("int"))
    found = carry(df, "ffill", ["day", "ord"], ["a", "b", "n"], buckets=6)
    assert rows(found.drop("day"), "ord") == plain(frame(data).ffill())
    text_order = df.withColumn("t", F.lpad(F.col("ord").cast("string"), 6, "0")).drop("day")
    found = carry(text_order, "bfill", "t", ["a", "b", "n"], buckets=6)
    assert rows(found.drop("t"), "ord") == plain(frame(data).bfill())


def test_bounds_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(nulls, "SAMPLE_PER_BUCKET", 5)
    monkeypatch.setattr(nulls, "ROWS_PER_BUCKET", 20)
    data = random_rows(9)
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(carry(df, "ffill", "ord"), "ord") == plain(frame(data).ffill())
    assert nulls._bucketed(df, ["ord"], None).select("_bucket").distinct().count() > 8


def test_carry_over_time(spark):
    data = random_rows(6)
    df = spark.createDataFrame(data, SCHEMA).withColumn(
        "ts", F.timestamp_seconds(F.col("ord") * 7).cast("timestamp_ntz")
    )
    found = carry(df, "ffill", "ts", ["a", "b", "n"], buckets=5)
    assert rows(found.drop("ts"), "ord") == plain(frame(data).ffill())


def test_a_missing_order_key_comes_first(spark):
    df = spark.createDataFrame([(None, "first"), *[(i, None) for i in range(9)]], "o long, `b.x` string")
    assert carry(df, "ffill", "o", buckets=3).where("`b.x` = 'first'").count() == 10
    grouped = carry(df.withColumn("g.h", F.lit(1)), "ffill", "o", ["b.x"], ["g.h"], 3, hot_rows=1)
    assert grouped.where("`b.x` = 'first'").count() == 10


def test_drop(spark):
    data = [(1, 1.0, "x", 1), (2, NAN, "x", 1), (3, 1.0, None, None), (4, None, "y", 2)]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[0] for r in rows(drop_nulls(df), "ord")] == [1]
    assert [r[0] for r in rows(drop_nulls(df, ["b"]), "ord")] == [1, 2, 4]
    with pytest.raises(KeyError):
        drop_nulls(df, ["zz"])


def test_fill(spark):
    df = spark.createDataFrame([(1, NAN, None, None), (2, 2.5, "q", 7)], SCHEMA)
    assert rows(fill_nulls(df, 0), "ord") == [(1, 0.0, None, 0), (2, 2.5, "q", 7)]
    assert rows(fill_nulls(df, "z"), "ord")[0][2] == "z"
    assert rows(fill_nulls(df, 0.5), "ord") == [(1.0, 0.5, None, 0.5), (2.0, 2.5, "q", 7.0)]
    assert rows(fill_nulls(df, {"a": 1, "b": "k", "other": 3}), "ord")[0] == (1, 1.0, "k", None)
    assert fillable_columns(df, "z") == ["b"]
    with pytest.raises(TypeError):
        fill_nulls(df, {"n": "text"})
    with pytest.raises(TypeError):
        fill_nulls(df, True)


def test_handle_nulls_parameters(spark):
    df = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    for bad in ({}, {"value": 1, "method": "ffill"}, {"method": "sideways", "order_by": "ord"}):
        with pytest.raises(ValueError):
            handle_nulls(df, "fill", **bad)
    with pytest.raises(ValueError):
        handle_nulls(df, "erase")


def test_counts(spark):
    data = [(1, NAN, None, 1), (2, None, "x", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    assert dict(rows(null_census(df))) == {"ord": 0, "a": 2, "b": 1, "n": 0}
    assert tuple(null_report(df, fill_nulls(df, 0.0)).first()) == (3, 1)
