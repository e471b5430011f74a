import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tidemark-tests", shuffle_partitions=8, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def business_days(spark):
    from tidemark.operators import calendar

    days = spark.sql(
        "SELECT explode(sequence(DATE'2020-01-01', DATE'2020-12-31', interval 1 day)) AS date"
    ).where("dayofweek(date) NOT IN (1, 7)")
    return calendar.calendar(days)
