"""The operators on unbounded input.

Row-wise stages are the batch functions themselves. What differs is time: every
stream carries a watermark, rows later than it are dropped and counted by Spark
in the query progress, and exact per-event windows use keyed state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import registry as R
from ..operators import ueba
from ..operators.detectors import owasp_scan, scanned, signature_hits, with_pattern
from ..operators.windows import first_row
from ..session import scratch
from ..sources.json_lines import parse_jsonl_events
from .processors import EwmaSpikes, OrderedProcessor, SiteBlocks, SlidingWindow, SuppressRepeats, UserRisk

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"
#: Shares of the keys with exact state; each is worked on as one. A checkpoint belongs to its number.
SHARES = 2_048

WINDOW_OUT = "key string, event_id long, ts_us long, n long, n_distinct long, first_us long"
BLOCK_OUT = "key string, event_id long, ts_us long, site string, hits long"
EWMA_OUT = "key string, event_id long, ts_us long, n_sample long, z double, spike boolean"
RISK_OUT = "key string, event_id long, ts_us long, logins long, score double, factors string"
SUPPRESS_OUT = "key string, event_id long, ts_us long, status string"


def stream_table(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def stream_events(spark: SparkSession, folder: str, ingest_us: int) -> DataFrame:
    """Growing JSONL event logs."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "line")
    return parse_jsonl_events(lines, ingest_us)


def with_event_time(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def hits_stream(events: DataFrame, delay: str = WATERMARK, *, quiet_s: int = 86_400) -> DataFrame:
    """Signature hits joined to the registry, the first of each pattern, source and text.

    Repeats follow event time, not arrival. The same hit counts again once it is
    more than ``quiet_s`` after the one that was kept.
    """
    found = signature_hits(scanned(events))
    key = F.to_json(F.struct("pattern_id", "src_ip", F.substring("matched", 1, 60).alias("matched")))
    kept = suppress_stream(found, key, window_s=quiet_s, delay=delay).where("status = 'sent'")
    parts = kept.select("event_id", "ts_us", F.from_json("key", "pattern_id string, src_ip string, matched string").alias("_h"))
    return with_pattern(parts.select("event_id", "ts_us", "_h.*"))


def counts_stream(events: DataFrame, keys: list[str], width: str = "1 minute", slide: str | None = None,
                  delay: str = WATERMARK, min_count: int = 1) -> DataFrame:
    """Tumbling or sliding counts; with a slide this is the cheap form of the window rules."""
    windows = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    counts = with_event_time(events, delay).groupBy(windows, *keys).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count).select(
        F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), *keys, "n"
    )


def session_stream(events: DataFrame, keys: list[str], gap: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """Activity sessions that close after a quiet gap."""
    sessions = with_event_time(events, delay).groupBy(F.session_window("event_time", gap), *keys).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    return sessions.drop("session_window")


def _keyed(rows: DataFrame, key: Column, processor: OrderedProcessor, schema: str, delay: str,
           member: Column | None = None, value: Column | None = None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    none = F.lit("")
    shaped = with_event_time(rows, delay).select(
        "event_time", F.pmod(F.xxhash64(key), F.lit(SHARES)).alias("share"), key.alias("key"), "ts_us", "event_id",
        (none if member is None else member.cast("string")).alias("member"),
        (none if value is None else value.cast("string")).alias("value"),
    )
    return shaped.groupBy("share").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(schema), outputMode="Append", timeMode="EventTime"
    )


def sliding_window_stream(rows: DataFrame, key: Column, window_s: int, min_rows: int, *, member: Column | None = None,
                          min_distinct: int = 0, fire_from_us: int = 0, max_per_member: int | None = None,
                          delay: str = WATERMARK) -> DataFrame:
    """Exact per-event windows: brute force, spray, distributed attempts, travel, bursts, site blocks.

    ``fire_from_us`` lets older rows fill windows without firing; with
    ``max_per_member`` a window in which a member has more rows does not fire.
    """
    processor = SlidingWindow(window_s, min_rows, min_distinct, fire_from_us, max_per_member)
    return _keyed(rows, key, processor, WINDOW_OUT, delay, member)


def auto_block_stream(events: DataFrame, sites: DataFrame, *, window_s: int, threshold: int, delay: str = WATERMARK) -> DataFrame:
    """Site blocks from signature and request-scan hits: (key: source, event_id, ts_us, site, hits) of each first crossing."""
    requests = scanned(events)
    pattern = signature_hits(requests).withColumn("kind", F.lit("pattern")).withColumn("text", F.concat_ws("|", "pattern_id", F.substring("matched", 1, 60)))
    injection = owasp_scan(requests).withColumn("kind", F.lit("injection")).withColumn("text", F.substring("msg", 1, 60))
    columns = ["event_id", "ts_us", F.trim("src_ip").alias("src_ip"), "host", "kind", "text"]
    hits = pattern.select(*columns).unionByName(injection.select(*columns)).where(~F.col("src_ip").isin(*R.PLACEHOLDER_IPS))
    named = hits.join(sites.select(F.col("name").alias("host"), F.col("name").alias("site")), "host", "left")
    return _keyed(named, F.col("src_ip"), SiteBlocks(window_s, threshold), BLOCK_OUT, delay, value=F.to_json(F.struct("site", "kind", "text")))


def ewma_stream(rows: DataFrame, key: Column, value: Column, *, alpha: float = 0.3, threshold: float = 3.0,
                warmup: int = 10, delay: str = WATERMARK) -> DataFrame:
    return _keyed(rows, key, EwmaSpikes(alpha, threshold, warmup), EWMA_OUT, delay, value=value)


def suppress_stream(alerts: DataFrame, key: Column, *, window_s: int = 900, delay: str = WATERMARK) -> DataFrame:
    return _keyed(alerts, key, SuppressRepeats(window_s), SUPPRESS_OUT, delay)


def risk_stream(events: DataFrame, *, delay: str = WATERMARK, keep_s: int = 365 * 86_400) -> DataFrame:
    """User risk with the factors and weights of the batch operator; sources and hosts not seen for ``keep_s`` are new again."""
    weights = {
        "new_ip": ueba.WEIGHT_NEW_IP, "off_hours": ueba.WEIGHT_OFF_HOURS, "failures": ueba.WEIGHT_FAILURES,
        "burst": ueba.WEIGHT_BURST, "new_host": ueba.WEIGHT_NEW_HOST,
    }
    processor = UserRisk(weights, ueba.MIN_LOGINS, ueba.ATTEMPT_SPAN, ueba.EVENT_SPAN, ueba.BURST_SPAN_S, keep_s)
    known = events.where(~F.col("user").isin(*R.PLACEHOLDER_USERS))
    value = F.to_json(F.struct(
        "event", F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"), F.coalesce("host", F.lit("-")).alias("host")
    ))
    return _keyed(known, F.col("user"), processor, RISK_OUT, delay, value=value)


def append_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once append to Parquet."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def ledger_sink(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame],
                trigger: dict | None = None) -> StreamingQuery:
    """Append shaped batches under their batch id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def run_available(stream: DataFrame) -> DataFrame:
    """Process all input that is there now and return the output rows."""
    spark = stream.sparkSession
    root = f"{scratch(spark)}/{uuid.uuid4().hex}"
    query = append_sink(stream, f"{root}/out", f"{root}/state", {"availableNow": True})
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_released(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Input that arrives part by part: (output rows, input rows that came behind the watermark and were dropped).

    Each part is written to the watched folder and processed to its end before the
    next one is; state, watermark and output go on from the same checkpoint.
    """
    spark = parts[0].sparkSession
    root, dropped = f"{scratch(spark)}/{uuid.uuid4().hex}", 0
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        out = build(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        query = append_sink(out, f"{root}/out", f"{root}/state", {"availableNow": True})
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(out.schema).parquet(f"{root}/out"), dropped


class LateRows(StreamingQueryListener):
    """Counts the rows that fell behind the watermark, by query, over all batches while it is registered."""

    def __init__(self) -> None:
        self.by_query: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.by_query.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self.by_query[key] = self.by_query.get(key, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str = "ts_us",
                trigger: dict | None = None, *, buckets: int = 16, compact_after: int = 8) -> StreamingQuery:
    """Keep the latest row per key as a log of deltas by key bucket.

    A batch writes the latest row of each of its own keys and nothing else, under its
    batch id, so a repeated batch replaces itself. A bucket with more than ``compact_after`` deltas since its
    last base gets a new base; the other buckets stay as they are. ``latest_state`` merges on read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        latest = first_row(batch, keys, [F.desc(order)]).withColumn("bucket", bucket)
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/batch_id={batch_id}")
        log = _log(spark, path)
        # At most one row per bucket.
        due = [r.bucket for r in log.where("since > 0").groupBy("bucket").agg(F.count_distinct("batch_id").alias("n")).where(F.col("n") > compact_after).collect()]
        if due:
            merged = first_row(log.where(F.col("bucket").isin(*due)).drop("since", "batch_id"), keys, [F.desc(order)])
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/upto={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each bucket's newest base (``since`` 0) and of the deltas after it (``since`` 1)."""
    delta = spark.read.option("basePath", f"{path}/delta").parquet(f"{path}/delta")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return delta.withColumn("since", F.lit(1))
    base = spark.read.option("basePath", f"{path}/base").parquet(f"{path}/base")
    newest = base.groupBy("bucket").agg(F.max("upto").alias("newest"))
    kept = base.join(newest, "bucket").where(F.col("upto") == F.col("newest")).withColumn("since", F.lit(0))
    after = delta.join(newest, "bucket", "left").where(F.col("newest").isNull() | (F.col("batch_id") > F.col("newest"))).withColumn("since", F.lit(1))
    return after.drop("newest").unionByName(kept.drop("newest").withColumnRenamed("upto", "batch_id"))


def latest_state(spark: SparkSession, path: str, keys: list[str], order: str = "ts_us") -> DataFrame:
    """The latest row per key of an ``upsert_sink``."""
    return first_row(_log(spark, path).drop("since", "batch_id", "bucket"), keys, [F.desc(order)])
