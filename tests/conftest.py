import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepane.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return BASE + timedelta(seconds=seconds)


def seconds(stamp: datetime) -> float:
    return (stamp - BASE).total_seconds()


@pytest.fixture(scope="session")
def make_obs(spark):
    """Observations from ``(topic, seconds, value)`` rows."""

    def make(rows):
        data = [(f"obs{i}", topic, at(t), float(v), i) for i, (topic, t, v) in enumerate(rows)]
        return spark.createDataFrame(
            data, "subject STRING, topic STRING, ts TIMESTAMP_NTZ, value DOUBLE, arrival BIGINT"
        )

    return make


@pytest.fixture(scope="session")
def make_windows(spark):
    """Result windows from ``(topic, start, end, value)`` rows, times in seconds."""

    def make(rows):
        data = [(topic, at(s), at(e), float(v)) for topic, s, e, v in rows]
        return spark.createDataFrame(
            data, "topic STRING, w_start TIMESTAMP_NTZ, w_end TIMESTAMP_NTZ, value DOUBLE"
        )

    return make


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
