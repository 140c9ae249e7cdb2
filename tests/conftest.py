import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from telemetra.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "telemetra-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def logs(spark):
    """Records from {log_id: {channel: values}}; t is idx / 10 unless given."""

    def build(data):
        rows, names = [], None
        for log_id, channels in data.items():
            times = channels.get("t")
            names = [c for c in channels if c != "t"]
            for i, cells in enumerate(zip(*[channels[c] for c in names])):
                t = times[i] if times else i / 10
                rows.append((log_id, i, float(t), *[None if c is None else float(c) for c in cells]))
        fields = ", ".join(f"`{n}` double" for n in names)
        return spark.createDataFrame(rows, f"log_id string, idx long, t double, {fields}")

    return build
