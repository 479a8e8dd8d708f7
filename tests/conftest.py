import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelyard.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4",
                  spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.sparkContext.setLogLevel("ERROR")
    return s


def months(n, start="2000-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


@pytest.fixture(scope="session")
def monthly_returns():
    rng = np.random.default_rng(7)
    return pd.DataFrame([(d, f"C{i:02d}", float(rng.normal(0.005, 0.05))) for d in months(36) for i in range(12)], columns=["date", "entity", "ret"])


@pytest.fixture(scope="session")
def daily_returns():
    rng = np.random.default_rng(11)
    days = [d.date() for d in pd.bdate_range("2010-01-01", periods=300)]
    return pd.DataFrame([(d, f"C{i:02d}", float(rng.normal(0, 0.02))) for d in days for i in range(20)], columns=["date", "entity", "ret"])
