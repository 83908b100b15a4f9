"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Hour-of-day rules are defined on UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hubs and hot keys are split well before they fill a task's memory.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    # Batches of long texts stay small in Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # CEF extensions may repeat a key; the last value wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; cluster sizing is left alone."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a temporary one where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="auditlark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


# The scratch folder of each application.
_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application inside the shared one; it is removed when the driver ends."""
    context = spark.sparkContext
    if context.applicationId not in _SCRATCH:
        folder = f"{checkpoint_root(spark)}/auditlark-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _SCRATCH[context.applicationId] = folder
    return _SCRATCH[context.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the scratch folder and read it back.

    For results that several later steps read: the lineage ends here, and the
    files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
