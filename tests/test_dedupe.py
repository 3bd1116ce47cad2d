import random

import pandas as pd
import pytest
from conftest import rows

from tidegate.operators.dedupe import dedupe_report, drop_duplicates

SCHEMA = "k string, x double, v long, ord long"


def random_rows(seed, n=200):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b", None]), rng.choice([1.0, float("nan"), None]), rng.randrange(3), i)
        for i in range(n)
    ]


def as_pandas(data):
    return pd.DataFrame(data, columns=["k", "x", "v", "ord"])


def clean(found):
    return [tuple(None if v != v else v for v in row) for row in found]


@pytest.mark.parametrize("keep", ["first", "last", False])
@pytest.mark.parametrize("subset", [["k"], ["k", "x"], ["k", "x", "v"], ["x", "v"]])
def test_matches_pandas(spark, keep, subset):
    data = random_rows(len(subset), n=120 if keep else 8)
    found = drop_duplicates(spark.createDataFrame(data, SCHEMA), subset, keep, "ord")
    expected = as_pandas(data).drop_duplicates(subset=subset, keep=keep)["ord"].tolist()
    assert sorted(row.ord for row in found.collect()) == expected


def test_whole_rows(spark):
    data = [(k, x, v, 0) for k, x, v, _ in random_rows(7)]
    df = spark.createDataFrame(data, SCHEMA)
    found = clean(rows(drop_duplicates(df)))
    assert len(found) == len(as_pandas(data).drop_duplicates())
    assert sorted(map(repr, set(found))) == sorted(map(repr, found))
    assert drop_duplicates(df, keep=False).count() == len(as_pandas(data).drop_duplicates(keep=False))


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_report_counts(spark, keep):
    data = random_rows(3)
    report = dedupe_report(spark.createDataFrame(data, SCHEMA), ["k", "v"], keep).first()
    kept = len(as_pandas(data).drop_duplicates(subset=["k", "v"], keep=keep))
    assert tuple(report) == (200, kept, 200 - kept)
    empty = spark.createDataFrame([], SCHEMA)
    assert tuple(dedupe_report(empty, ["k"], keep).first()) == (0, 0, 0)


def test_errors(spark):
    df = spark.createDataFrame(random_rows(1), SCHEMA)
    with pytest.raises(KeyError):
        drop_duplicates(df, ["nope"], order_by="ord")
    with pytest.raises(ValueError):
        drop_duplicates(df, ["k"], keep="middle", order_by="ord")
    with pytest.raises(ValueError, match="order"):
        drop_duplicates(df, ["k"])


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.createDataFrame(random_rows(1), SCHEMA)
    for keep, operator in (("first", "WindowGroupLimit"), (False, "partial_count")):
        plan = drop_duplicates(df, ["k"], keep, "ord")._jdf.queryExecution().executedPlan().toString()
        below_shuffle = plan[plan.index("Exchange") :]
        assert operator in below_shuffle
