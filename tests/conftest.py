import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from auditlark.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


US = 1_000_000
EVENT_SCHEMA = (
    "event_id long, ts_us long, event string, user string, src_ip string, host string, asset_class string, msg string"
)


@pytest.fixture
def events(spark):
    def make(rows):
        """rows: dicts with at least ts (seconds) and event."""
        full = [
            (
                i, int(r["ts"] * US), r["event"], r.get("user", "alice"), r.get("src_ip", "9.9.9.9"),
                r.get("host", "web-1"), r.get("asset_class", "Standard"), r.get("msg", ""),
            )
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make
