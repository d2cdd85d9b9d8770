import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tidewatch.schemas import SCORED_PACKET_SCHEMA  # noqa: E402
from tidewatch.session import session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tidewatch-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCORED_PACKET_SCHEMA)
