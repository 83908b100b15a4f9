"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length. Each byte has an
embedding, filters of several widths run over a window, each keeps its largest
response, and a softmax layer turns these into class scores. A text's score is
the mean of its windows' log-probabilities, so every byte of the text counts.

Embedding and filters multiply into one table per filter position (256 byte
values times filters), so a response is a sum of table rows. Training is plain
numpy: only the position of a filter's maximum receives a gradient. The model
has a fixed size and is broadcast.

Defined results: a null text, an empty one and one without a letter is ``und``
with score 0; without training rows everything is ``und``; rows without a
language never train; repeated rows score alike; columns of the input are kept,
clashing outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlark.session import materialize

from .texts import text_buffers

UNKNOWN = "und"
#: The bounded training sample: distinct texts of a language, of all languages (one each at least), windows of a text.
DOCS_PER_LANGUAGE = 600
SAMPLE_DOCS = 60_000
WINDOWS_PER_DOC = 6
WINDOW = 128
#: Windows scored at once.
BATCH = 1_024


@dataclass(frozen=True)
class Shape:
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    epochs: int = 4
    batch: int = 128
    rate: float = 0.01
    seed: int = 5


@dataclass(frozen=True)
class Network:
    """``tables``: per width an array (width, 256, filters); ``out``, ``bias``: the softmax layer."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of uint8 windows (n, WINDOW)."""
        pooled = np.concatenate([responses(windows, t).max(1) for t in self.tables], axis=1)
        return _log_softmax(np.maximum(pooled + self.shift, 0) @ self.out + self.bias)


def responses(windows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, positions, filters) of one width."""
    width = len(table)
    n = windows.shape[1] - width + 1
    total = np.take(table[0], windows[:, :n], axis=0)
    for j in range(1, width):
        total += np.take(table[j], windows[:, j:j + n], axis=0)
    return total


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(data: np.ndarray) -> np.ndarray:
    """All windows of a text's bytes; the last one is filled with blanks."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, 32, np.uint8)
    out[:len(data)] = data
    return out.reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], shape: Shape = Shape()) -> Network:
    """Adam on the cross-entropy of uint8 windows (n, WINDOW) with class numbers ``labels``."""
    rng = np.random.default_rng(shape.seed)
    d, f, k = shape.embedding, shape.filters, len(languages)
    p = {"e": rng.normal(0, 0.5, (256, d)), "s": np.zeros(f * len(shape.widths)), "b": np.zeros(k)}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)) for w in shape.widths}
    p["o"] = rng.normal(0, 0.2, (f * len(shape.widths), k))
    moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in p.items()}
    # Classes count alike, however many windows each has.
    weight = (len(labels) / np.maximum(np.bincount(labels, minlength=k), 1) / k)[labels]
    step = 0
    for _ in range(shape.epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), shape.batch):
            x, y = windows[order[a:a + shape.batch]], labels[order[a:a + shape.batch]]
            n = len(x)
            pooled, places = [], []
            for w in shape.widths:
                r = responses(x, np.einsum("vd,wdf->wvf", p["e"], p[f"w{w}"]))
                places.append(r.argmax(1))
                pooled.append(np.take_along_axis(r, places[-1][:, None], 1)[:, 0])
            z = np.concatenate(pooled, 1) + p["s"]
            active = np.maximum(z, 0)
            dz = np.exp(_log_softmax(active @ p["o"] + p["b"]))
            dz[np.arange(n), y] -= 1
            dz *= weight[order[a:a + shape.batch], None] / n
            g = {"o": active.T @ dz, "b": dz.sum(0), "e": np.zeros_like(p["e"])}
            dp = (dz @ p["o"].T) * (z > 0)
            g["s"] = dp.sum(0)
            for i, w in enumerate(shape.widths):
                own = dp[:, i * f:(i + 1) * f]
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    byte = np.take_along_axis(x, places[i] + j, 1)  # (n, f): the byte under the filter's maximum
                    g[f"w{w}"][j] = np.einsum("nf,nfd->df", own, p["e"][byte])
                    np.add.at(g["e"], byte, own[:, :, None] * p[f"w{w}"][j].T[None])
            step += 1
            for name, v in p.items():
                m, s = moments[name]
                m += 0.1 * (g[name] - m)
                s += 0.001 * (g[name] ** 2 - s)
                v -= shape.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    tables = tuple(np.einsum("vd,wdf->wvf", p["e"], p[f"w{w}"]).astype(np.float32) for w in shape.widths)
    return Network(languages, tables, p["s"].astype(np.float32), p["o"].astype(np.float32), p["b"].astype(np.float32))


def training_windows(docs: DataFrame) -> DataFrame:
    """(lang, window): evenly spread windows of at most DOCS_PER_LANGUAGE distinct texts of every language.

    The texts with the smallest hashes are drawn, after copies have become one; with
    many languages each gets an equal share of SAMPLE_DOCS, at least one text.
    """
    usable = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(F.col("lang").cast("string"), "text", F.xxhash64("text", "lang").alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw")
    drawn = usable.select("lang", "draw").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DOCS_PER_LANGUAGE)
    # Written, so that the planner knows its size and need not shuffle the texts.
    drawn = materialize(drawn)
    share = max(1, SAMPLE_DOCS // max(1, drawn.filter("place = 1").count()))
    chosen = usable.join(drawn.filter(F.col("place") <= share).select("lang", "draw"), ["lang", "draw"], "left_semi")
    chosen = chosen.dropDuplicates(["lang", "draw"]).select("lang", "text")

    def run(batches):
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            langs, out = batch.column(0).to_pylist(), ([], [])
            for row, lang in enumerate(langs):
                found = windows_of(data[at[row]:at[row + 1]])
                for w in np.unique(np.linspace(0, len(found) - 1, WINDOWS_PER_DOC).astype(int)) if len(found) else ():
                    out[0].append(lang)
                    out[1].append(found[w].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["lang", "window"])

    return chosen.mapInArrow(run, "lang string, window binary")


def fit(docs: DataFrame, shape: Shape = Shape()) -> Network | None:
    """A network from ``docs`` (text, lang); None without any row to learn from."""
    sample = training_windows(docs).toArrow().to_pydict()
    rows = sorted(zip(sample["lang"], sample["window"]))
    if not rows:
        return None
    languages = tuple(sorted({lang for lang, _ in rows}))
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([number[lang] for lang, _ in rows]), languages, shape)


def has_letter(text) -> F.Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean-log-probability share of the winning language."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for batch in batches:
            data, at = text_buffers(batch.column(text))
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, total in text_scores(data, at, net) if net else ():
                p = np.exp(_log_softmax(total))
                best[a:b], score[a:b] = p.argmax(1), p.max(1)
            names = pa.array(net.languages if net else [UNKNOWN], pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    found = docs.mapInArrow(run, schema)
    known = has_letter(F.col(text)) & F.lit(network is not None)
    return found.withColumns({
        "lang_pred": F.when(known, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(known, F.col("score")).otherwise(0.0),
    })


def text_scores(data: np.ndarray, at: np.ndarray, net: Network):
    """(a, b, mean log-probabilities of rows a to b): windows of many rows, or of a part of one, are scored together."""
    counts = -(-np.diff(at) // WINDOW)
    row, n = 0, len(counts)
    while row < n:
        last = row + 1
        held = counts[row]
        while last < n and held + counts[last] <= BATCH:
            held += counts[last]
            last += 1
        total = np.zeros((last - row, len(net.languages)))
        if last - row == 1:
            own = data[at[row]:at[row + 1]]
            for a in range(0, len(own), BATCH * WINDOW):
                total[0] += net.log_probabilities(windows_of(own[a:a + BATCH * WINDOW])).sum(0)
        else:
            whole = np.concatenate([windows_of(data[at[i]:at[i + 1]]) for i in range(row, last)])
            if len(whole):
                np.add.at(total, np.repeat(np.arange(last - row), counts[row:last]), net.log_probabilities(whole))
        yield row, last, total / np.maximum(counts[row:last], 1)[:, None]
        row = last
