"""Toxicity by a classifier chain.

The links of a chain predict their categories one after the other. Each link is
a sparse logistic regression on the set of words and word stems of a text, plus
the probabilities of all earlier links. Word weights are kept non-negative: a text
is toxic for what it holds, and harmless words around an insult do not excuse it. While a link trains, the earlier
probabilities of its rows come from models that have not seen them (out-of-fold
predictions); for scoring, each link is then trained on all rows. A repeated
word counts once, since one insult is as telling in a long text as in a short one.

Features are 64-bit hashes that occur in at least ``min_docs`` training texts;
proximal steps set most weights to zero, and a text is scored by looking up its
tokens among the remaining hashes, so other words cannot collide with them.

Defined results: null and empty texts have no features and score the biases;
a chain without training rows scores 0 everywhere; rows with a null label never
train; repeated rows score alike; columns of the input are kept, clashing
outputs are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import row_slices, text_buffers, token_hashes

#: At most so many labelled rows train; longer texts (in tokens) do not train, but are scored whole.
TRAIN_ROWS = 5_000
TRAIN_TOKENS = 20_000
#: Bytes of a word that stand for its stem, for inflected and compound forms.
STEM_BYTES = (4, 5)

# Words whose presence in a text labelled toxic marks the finer categories.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "imbecile", "dumb"),
    "contempt": ("worthless", "pathetic", "disgusting", "useless", "ugly"),
    "dehumanising": ("scum", "trash", "vermin", "garbage", "filth"),
}
LINKS = (*SEEDS, "toxic")
#: A text counts as toxic from this probability on; one text in ten is, so a single insult is enough.
TOXIC_AT = 0.25


@dataclass(frozen=True)
class Training:
    folds: int = 3
    steps: int = 60
    rate: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-5
    min_docs: int = 6


@dataclass(frozen=True)
class Chain:
    """``hashes`` (sorted) and ``weights`` (hash, link); ``earlier`` (link, link) below the diagonal; ``bias`` (link)."""

    links: tuple[str, ...]
    hashes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of the stems of longer words, repeats included."""
    h, first = token_hashes(data, offsets, STEM_BYTES)
    row = np.tile(np.repeat(np.arange(len(first) - 1), np.diff(first)), len(h))
    h = h.reshape(-1)
    return row[h != 0], h[h != 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, n_col: int, params: Training) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the set features, of the ``dense`` columns, and the bias, by proximal steps with per-weight rates."""
    n, k = dense.shape
    w, v, b = np.zeros(n_col), np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    gw, gv, gb = np.full(n_col, 1e-8), np.full(k, 1e-8), 1e-8
    for _ in range(params.steps):
        error = (_sigmoid(np.bincount(row, w[col], n) + dense @ v + b) - y) / n
        g = np.bincount(col, error[row], n_col) + params.l2 * w
        gw += g * g
        rate = params.rate / np.sqrt(gw)
        w = w - rate * g
        w = np.maximum(w - rate * params.l1, 0)
        g = dense.T @ error + params.l2 * v
        gv += g * g
        v = v - params.rate / np.sqrt(gv) * g
        g = error.sum()
        gb += g * g
        b -= params.rate / np.sqrt(gb) * g
    return w, v, b


def train(row: np.ndarray, hashes: np.ndarray, labels: np.ndarray, links: Sequence[str], params: Training = Training()) -> Chain:
    """A chain from (row, hash) pairs and ``labels`` (row, link)."""
    n, k = labels.shape
    pairs = np.unique(np.stack([hashes, row.astype(np.uint64)]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
    names, col, seen = np.unique(pairs[0], return_inverse=True, return_counts=True)
    frequent = seen >= params.min_docs
    keep = frequent[col]
    row, col = pairs[1][keep].astype(np.int64), (np.cumsum(frequent) - 1)[col[keep]]
    names = names[frequent]
    fold = np.arange(n) % params.folds
    weights, earlier, bias = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)
    outside = np.zeros((n, 0))  # out-of-fold probabilities of the links so far
    for j in range(k):
        y = labels[:, j]
        found = np.zeros(n)
        for f in range(params.folds):
            own = fold == f
            if own.all() or not own.any():
                continue
            number = np.cumsum(~own) - 1
            used = ~own[row]
            w, v, b = logistic(number[row[used]], col[used], outside[~own], y[~own], len(names), params)
            margin = np.bincount(row, w[col], n) + outside @ v + b
            found[own] = _sigmoid(margin[own])
        w, v, b = logistic(row, col, outside, y, len(names), params)
        weights[:, j], earlier[j, :j], bias[j] = w, v, b
        outside = np.column_stack([outside, found])
    used = (weights != 0).any(1)
    return Chain(tuple(links), names[used], weights[used], earlier, bias)


def fit(rows: DataFrame, links: Sequence[str] = LINKS, params: Training = Training()) -> Chain:
    """A chain from a bounded sample ``rows`` (text and one 0/1 column for each link), trained in one task."""
    links = tuple(links)

    def run(batches):
        row, hashes, labels, n = [], [], [], 0
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            y = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in links])
            for i in range(batch.num_rows):
                _, h = feature_sets(data, at[i:i + 2])
                if len(h) <= 3 * TRAIN_TOKENS:
                    found = np.unique(h)
                    row.append(np.full(len(found), n))
                    hashes.append(found)
                    labels.append(y[i])
                    n += 1
        if n:
            chain = train(np.concatenate(row), np.concatenate(hashes), np.array(labels, float), links, params)
            out = io.BytesIO()
            np.savez(out, hashes=chain.hashes, weights=chain.weights, earlier=chain.earlier, bias=chain.bias)
            yield pa.RecordBatch.from_pydict({"chain": [out.getvalue()]})

    sample = rows.select("text", *[F.col(c).cast("double") for c in links]).dropna(subset=list(links)).coalesce(1)
    found = sample.mapInArrow(run, "chain binary").collect()
    if not found:
        return Chain(links, np.zeros(0, np.uint64), np.zeros((0, len(links))), np.zeros((len(links),) * 2), np.full(len(links), -np.inf))
    with np.load(io.BytesIO(bytes(found[0]["chain"]))) as parts:
        return Chain(links, *(parts[c] for c in ("hashes", "weights", "earlier", "bias")))


def probabilities(data: np.ndarray, offsets: np.ndarray, chain: Chain) -> np.ndarray:
    """(row, link) of whole texts."""
    n, k = len(offsets) - 1, len(chain.links)
    margin = np.tile(chain.bias, (n, 1))
    if len(chain.hashes):
        row, h = feature_sets(data, offsets)
        # Most tokens end at a table of the hashes' leading bits.
        table = np.zeros(1 << 16, bool)
        table[(chain.hashes >> np.uint64(48)).astype(np.int64)] = True
        near = table[(h >> np.uint64(48)).astype(np.int64)]
        row, h = row[near], h[near]
        place = np.minimum(np.searchsorted(chain.hashes, h), len(chain.hashes) - 1)
        hit = chain.hashes[place] == h
        pairs = np.unique(row[hit] * len(chain.hashes) + place[hit])
        row, place = np.divmod(pairs, len(chain.hashes))
        for j in range(k):
            margin[:, j] += np.bincount(row, chain.weights[place, j], n)
    out = np.zeros((n, k))
    for j in range(k):
        out[:, j] = _sigmoid(margin[:, j] + out[:, :j] @ chain.earlier[j, :j]) if np.isfinite(chain.bias[j]) else 0.0
    return out


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with one probability column for each link."""
    names = [prefix + link for link in chain.links]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            data, at = text_buffers(batch.column(text))
            found = np.zeros((batch.num_rows, len(names)))
            for a, b in row_slices(at):
                found[a:b] = probabilities(data, at[a:b + 1], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in found.T.copy()]], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def with_categories(rows: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """``rows`` with a 0/1 column for each link: the finer ones where a toxic text holds one of their seed words."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    seeds = {c: (F.col(label) == 1) & low.rlike(rf"\b({'|'.join(words)})\b") for c, words in SEEDS.items()}
    return rows.withColumns({c: v.cast("double") for c, v in seeds.items()} | {"toxic": F.col(label).cast("double")})
