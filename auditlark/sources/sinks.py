"""Batch sinks; the streaming ones are in ``streaming.stream``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append incidents to the Parquet ledger, one folder per day."""
    dated = ledger.withColumn("day", F.to_date(F.timestamp_micros("ts_us")))
    dated.write.mode("append").partitionBy("day").parquet(path)


def export_forensics(timeline: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write timelines and attack chains as JSON lines; rows stay rows, however long a timeline is."""
    for name, df in (("timeline", timeline), ("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{path}/{name}")
