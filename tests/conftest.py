import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickwatch.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ticks(spark):
    from tickwatch.plans.domain import market_ticks

    return market_ticks(spark, SMALL)


@pytest.fixture(scope="session")
def features(spark):
    from tickwatch.plans.domain import market_features
    from tickwatch.session import stage

    return stage(market_features(spark, SMALL, "1 hour"))
