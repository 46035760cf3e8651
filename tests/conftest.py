import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stowline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one expression over a list of values, in order."""
    from pyspark.sql import functions as F

    def run(items, make, kind="string"):
        rows = spark.createDataFrame(list(enumerate(items)), f"n int, x {kind}")
        return [row.y for row in rows.select("n", make(F.col("x")).alias("y")).orderBy("n").collect()]

    return run
