import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from postloom.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def source(spark, folder):
    from postloom.plans.registry import Source

    return Source(spark, folder)


@pytest.fixture
def one(spark):
    """Value of a column rule for one input value."""
    from pyspark.sql import functions as F

    def run(value, rule, kind="string"):
        row = spark.createDataFrame([(value,)], f"v {kind}").select(rule(F.col("v")).alias("r")).first()
        return row["r"]

    return run
