import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

TESTS = Path(__file__).resolve().parent
sys.path.insert(0, str(TESTS.parent))
# Python workers import the package and the helpers of the tests.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(TESTS.parent), str(TESTS), os.environ.get("PYTHONPATH", "")]
)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def rows(df, *order):
    """Rows as tuples, sorted by all columns unless an order is given."""
    found = [tuple(row) for row in (df.orderBy(*order) if order else df).collect()]
    return found if order else sorted(found, key=repr)
