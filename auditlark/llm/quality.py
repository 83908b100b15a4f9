"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text are its word and punctuation tokens (lower case), their
bigrams, and one feature for a token that repeats the one before it; each is
hashed into ``buckets`` slots with the value count / sqrt(tokens). Weights come
from one pass per epoch of follow-the-regularised-leader updates (per-coordinate
rates, L1 and L2). A score is one sparse dot product, so scoring is a narrow map
over the table.

Defined results: a null or empty text has no features and scores the bias;
without usable labels every score is 0.5; rows with a null label or id never
train; repeated rows score alike; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import mixed, row_slices, row_sums, text_buffers, tidy, token_hashes

#: At most so many labelled rows train the model; the rows with the smallest hash of their id.
TRAIN_ROWS = 6_000


@dataclass(frozen=True)
class Ftrl:
    """Training parameters. ``buckets`` is a power of two."""

    buckets: int = 1 << 18
    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 2


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


_REPEAT = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xD1342543DE82EF95)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, first slot of each row and the end, tokens of each row).

    Every token gives two slots: itself, and its pair with the token before it in
    the same row (for a row's first token, its pair with the row's start).
    """
    h, first = token_hashes(data, offsets)
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < len(h)]] = 0
    pair = np.where(before == h, _REPEAT, mixed(before * _PAIR + h))
    slots = np.empty(2 * len(h), np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    slots[0::2] = (mixed(h) >> shift).astype(np.int64)
    slots[1::2] = (mixed(pair) >> shift).astype(np.int64)
    return slots, 2 * first, np.diff(first)


def scores(data: np.ndarray, offsets: np.ndarray, model: QualityModel) -> np.ndarray:
    slots, first, tokens = features(data, offsets, len(model.weights))
    margin = row_sums(model.weights[slots], first) / np.sqrt(np.maximum(tokens, 1)) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def train_stream(examples: Iterator[tuple[np.ndarray, np.ndarray, float]], params: Ftrl) -> QualityModel:
    """FTRL-proximal over (slots, values, label); slot ``buckets`` is the bias, which is not shrunk."""
    z, n = np.zeros(params.buckets + 1), np.zeros(params.buckets + 1)

    def weights(i):
        zi = z[i]
        l1 = np.where(i == params.buckets, 0.0, params.l1)
        rate = (params.beta + np.sqrt(n[i])) / params.alpha + params.l2
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / rate)

    for slots, values, label in examples:
        i = np.append(slots, params.buckets)
        x = np.append(values, 1.0)
        w = weights(i)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -40, 40)))
        g = (p - label) * x
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / params.alpha * w
        n[i] += g * g
    w = weights(np.arange(params.buckets + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def examples_of(batch: pa.RecordBatch, params: Ftrl) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Training rows of a batch (columns text, label), in order."""
    data, offsets = text_buffers(batch.column("text"))
    for row, label in enumerate(batch.column("label").to_pylist()):
        slots, _, tokens = features(data, offsets[row:row + 2], params.buckets)
        found, counts = np.unique(slots, return_counts=True)
        yield found, counts / np.sqrt(max(int(tokens[0]), 1)), float(label)


def training_rows(labelled: DataFrame, docs: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` rows (doc_id, text, label): the labelled documents with the smallest id hashes.

    Both cuts are distributed top-n, so the broadcast side has at most ``rows`` rows.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labelled.select("doc_id", F.col(label).cast("double").alias("label")).dropna()
        .orderBy(order, "doc_id", "label").limit(rows)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.orderBy(order, "doc_id", F.xxhash64("text"), "label").limit(rows)


def fit(labelled: DataFrame, docs: DataFrame, label: str = "quality", params: Ftrl = Ftrl(), rows: int = TRAIN_ROWS) -> QualityModel:
    """Train on ``labelled`` (doc_id, label) joined to ``docs`` (doc_id, text).

    FTRL is sequential, so its bounded sample streams once per epoch through one
    task, row by row; only the weights come back.
    """
    sample = training_rows(labelled, docs, label, rows).coalesce(1)
    passes = (
        sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(params.epochs))))
        .coalesce(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", "epoch"), "doc_id", "label", F.xxhash64("text"))
        .select("text", "label")
    )

    def run(batches):
        model = train_stream((e for b in batches for e in examples_of(b, params)), params)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    found = passes.mapInArrow(tidy(run), "weights binary, bias double").collect()
    if not found:
        return QualityModel(np.zeros(params.buckets, np.float32), 0.0)
    return QualityModel(np.frombuffer(bytes(found[0]["weights"]), np.float32), float(found[0]["bias"]))


def score_texts(docs: DataFrame, model: QualityModel, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``out``, the probability of label 1. A column of that name is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            found = np.empty(batch.num_rows)
            for a, b in row_slices(offsets):
                found[a:b] = scores(data, offsets[a:b + 1], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, out])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
