"""Outliers and spikes in numeric series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import shannon_entropy
from .windows import Total, find_slices, group_starts, ordered_scan, row_blocks, running_totals, spread, US


def zscore_outliers(df: DataFrame, keys: Sequence[str], value: str, *, threshold: float = 3.0) -> DataFrame:
    """Rows at least ``threshold`` population deviations from the mean of their key."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.count(value).alias("_n")
    ).where((F.col("_n") >= 3) & (F.col("_std") > 0))
    scored = df.join(stats, list(keys)).withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_std"))
    return scored.where(F.abs("z") >= threshold).drop("_mean", "_std", "_n")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, *, accuracy: int = 10_000) -> DataFrame:
    """Exact median per key without gathering a key.

    A bounded quantile sketch brackets the median; only values inside the
    bracket are counted one by one, the rest only as a total below it.
    """
    keys = list(keys)
    eps = 2.0 / accuracy
    bracket = df.groupBy(*keys).agg(
        F.percentile_approx(value, [0.5 - eps, 0.5 + eps], accuracy).alias("_q"), F.count(value).alias("_n")
    )
    inside = (
        df.select(*keys, F.col(value).alias("_v"))
        .where("_v IS NOT NULL")
        .join(bracket, keys)
        .where(F.col("_v") <= F.col("_q")[1])
        .select(*keys, "_n", F.when(F.col("_v") >= F.col("_q")[0], F.col("_v")).alias("_v"))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.sum("_c").over(w))
    low = F.min(F.when(F.col("_upto") >= F.floor((F.col("_n") + 1) / 2), F.col("_v")))
    high = F.min(F.when(F.col("_upto") >= F.floor(F.col("_n") / 2) + 1, F.col("_v")))
    return ranked.groupBy(*keys).agg(((low + high) / 2).alias("median"), F.first("_n").alias("n"))


def mad_outliers(df: DataFrame, keys: Sequence[str], value: str, *, threshold: float = 3.5) -> DataFrame:
    """Rows whose modified z-score, based on the median absolute deviation, reaches ``threshold``."""
    keys = list(keys)
    centre = exact_median(df, keys, value).where("n >= 3").drop("n")
    centred = df.join(centre, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    spread = exact_median(centred, keys, "_dev").where("median > 0").select(*keys, F.col("median").alias("mad"))
    scored = centred.join(spread, keys).withColumn(
        "mz", F.lit(0.6745) * (F.col(value) - F.col("median")) / F.col("mad")
    )
    return scored.where(F.abs("mz") >= threshold).drop("_dev")


def entropy(df: DataFrame, text: str) -> DataFrame:
    """Add ``entropy`` (bits per character)."""
    return df.withColumn("entropy", shannon_entropy(F.col(text)))


def entropy_outliers(df: DataFrame, text: str, *, threshold_bits: float = 4.0) -> DataFrame:
    return entropy(df, text).where(F.col("entropy") >= threshold_bits)


def ewma_spikes(
    df: DataFrame, keys: Sequence[str], value: str, *, alpha: float = 0.3, threshold: float = 3.0, warmup: int = 10,
    rank: str | None = None, block_rows: int = 200_000, ts: str = "ts_us", tie: str = "event_id",
) -> DataFrame:
    """Score every sample against the running mean and deviation before it.

    The state forgets a sample by a factor ``1 - alpha`` per step, so after
    enough steps its weight is below the smallest double. Each block of a key
    is therefore warmed up on that many earlier rows and needs nothing else
    from the blocks before it.
    """
    keys = list(keys)
    samples = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    if rank is None:
        rank = "n_sample"
        samples = running_totals(samples, keys, {rank: Total(F.lit(1))}, ts=ts, tie=tie)
    overlap = math.ceil(745 / -math.log1p(-alpha))
    blocks = row_blocks(samples, rank, max(block_rows, 10 * overlap), overlap)
    out = T.StructType(
        [f for f in samples.schema.fields]
        + [T.StructField(c, T.DoubleType()) for c in ("z", "mean", "var")]
        + [T.StructField("spike", T.BooleanType())]
    )
    names = out.fieldNames()
    group = [*keys, "block"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mean, var = None, 0.0, 0.0
        keep = 1.0 - alpha
        for pdf in batches:
            starts, last = group_starts(pdf, group, last)
            zs, means, variances = [], [], []
            for x, new in zip(pdf[value].tolist(), starts):
                if new:
                    z, mean, var = 0.0, x, 0.0
                else:
                    dev = x - mean
                    z = dev / max(math.sqrt(var), 0.05 * abs(mean) if mean != 0 else 1e-6)
                    mean, var = alpha * x + keep * mean, alpha * dev * dev + keep * var
                zs.append(z)
                means.append(mean)
                variances.append(var)
            pdf = pdf.assign(z=zs, mean=means, var=variances)
            pdf["spike"] = (pdf[rank] > warmup) & (pdf["z"] >= threshold)
            yield pdf.loc[~pdf["is_copy"], names]

    return ordered_scan(blocks, group, [rank], score, out)


def event_rate_series(
    events: DataFrame, keys: Sequence[str], *, span: int = 5, block_rows: int = 200_000, carry: Sequence[str] = ()
) -> DataFrame:
    """Mean of the last ``span`` arrival rates per key, one sample per distinct time.

    ``carry`` names columns of the first event of each time to keep.
    """
    keys = list(keys)
    first = F.min(F.struct("event_id", *carry)).alias("_e")
    arrivals = events.groupBy(*keys, "ts_us").agg(first).select(*keys, "ts_us", "_e.*")
    slices = find_slices(arrivals, keys)
    ranked = running_totals(arrivals, keys, {"arrival": Total(F.lit(1))}, slices=slices)
    w = Window.partitionBy(*keys, "block").orderBy("ts_us")
    rate = F.lit(float(US)) / (F.col("ts_us") - F.lag("ts_us").over(w))
    rated = spread(row_blocks(ranked, "arrival", block_rows, span + 1), slices.rows, *keys, "block").withColumn("rate", rate)
    series = rated.withColumn("rate_mean", F.avg("rate").over(w.rowsBetween(1 - span, 0)))
    return (
        series.where((F.col("arrival") > span) & ~F.col("is_copy"))
        .withColumn("n_sample", F.col("arrival") - span)
        .select(*keys, "ts_us", "event_id", *carry, "n_sample", "rate_mean")
    )


def rate_spikes(
    events: DataFrame, keys: Sequence[str], *, warmup: int = 15, threshold: float = 3.0, carry: Sequence[str] = ()
) -> DataFrame:
    """Spikes of the arrival rate with their 55-100 score."""
    series = event_rate_series(events, keys, carry=carry)
    scored = ewma_spikes(series, keys, "rate_mean", warmup=warmup, threshold=threshold, rank="n_sample")
    return scored.where("spike").withColumn("score", rate_score(F.col("z")))


def rate_score(z: Column) -> Column:
    return F.least(F.lit(100.0), F.lit(55.0) + F.least(F.lit(45.0), z * 5.0))
