"""Near-duplicates by SimHash fingerprints and the Jaccard similarity of word shingles.

A text's set holds the XXH64 hashes of its shingles (``simhash.shingle_hashes``). Candidates
come from two searches, and every link is verified on the whole sets before anything
is contracted. The covering tables of ``simhash`` find the fingerprints within ``RADIUS`` bits,
each a candidate with the one its bucket's search reached it from. What similar sets
lie further apart is found by ``BANDS`` bands of ``ROWS`` min-hashes: a pair at similarity s shares no
band with probability (1 - s^ROWS)^BANDS: 3 in a million at 0.8, less above.

Texts with equal sets fold into one node first, nodes with equal fingerprints meet
the smallest of them. A band's bucket is not compared pair by
pair: all its nodes are verified against its smallest one and contracted; only
buckets that then still hold several components are searched, in blocks, and
there only nodes of different components are compared.

Defined results: null, empty and blank texts have one empty set and are copies
of each other; a text shorter than a shingle is one shingle; rows with a null id
link like others and are kept only in a group without any id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.session import materialize

from .simhash import CHUNK as HASHES
from .simhash import components, fingerprint_of, keep_first, near_edges, shingle_hashes
from .texts import text_key, tidy

WORDS = 5
SIMILARITY = 0.8
#: Bits that fingerprints of the covering search may differ in.
RADIUS = 4
BANDS, ROWS = 24, 4
#: Nodes of a bucket that are searched in one piece.
BLOCK = 256
#: Shingles whose min-hashes are taken at once.
CHUNK = 1 << 12

_DRAWN = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1)).astype(np.uint64)
_SCALE, _SHIFT = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]
_BAND_COLUMNS = [f"band{i}" for i in range(BANDS)]


def _hashes(text: bytes, words: int) -> np.ndarray:
    found = list(shingle_hashes(text, words))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(_hashes(text, words))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), CHUNK):
        np.minimum(least, (own[a:a + CHUNK] * _SCALE + _SHIFT).min(1), out=least)
    data = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(row.tobytes()) for row in data), np.uint64, BANDS)


def _bytes(column: pa.Array) -> list[bytes]:
    texts = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    return [t.as_buffer().to_pybytes() for t in texts]


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, node, fp, band0, ...): ``node`` names the set, ``fp`` is the fingerprint."""

    def run(batches):
        for batch in batches:
            nodes, fps = np.zeros((2, batch.num_rows), np.uint64)
            keys = np.zeros((BANDS, batch.num_rows), np.uint64)
            for i, text in enumerate(_bytes(batch.column(2))):
                all_hashes = _hashes(text, words)
                own = np.unique(all_hashes)
                nodes[i], keys[:, i] = _node(own), band_keys(own)
                fps[i] = fingerprint_of(all_hashes[a:a + HASHES] for a in range(0, len(all_hashes), HASHES))
            columns = [pa.array(x.view(np.int64)) for x in (nodes, fps, *keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "text_key", "node", "fp", *_BAND_COLUMNS])

    narrow = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return narrow.mapInArrow(tidy(run), "doc_id long, text_key long, node long, fp long, " + ", ".join(f"{b} long" for b in _BAND_COLUMNS))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, grams) for each node of ``wanted`` (key, the text key of one of its texts)."""

    def run(batches):
        seen = set()
        for batch in batches:
            nodes, grams = [], []
            for text in _bytes(batch.column(0)):
                own = shingle_set(text, words)
                if (node := _node(own)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    grams.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"]
            )

    texts = docs.select(F.col("text").cast("string"), text_key().alias("key")).join(wanted.select("key"), "key", "left_semi").select("text")
    return texts.mapInArrow(tidy(run), "node long, grams array<long>").dropDuplicates(["node"])


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def _across(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Edges between nodes of different components of one bucket, until all that link are linked."""
    nodes, roots = rows["node"].to_numpy(), rows["root"].to_numpy().copy()
    sets = [np.sort(np.asarray(g, np.int64)) for g in rows["grams"]]
    edges = []
    for i, own in enumerate(sets):
        for j in np.flatnonzero(roots != roots[i]):
            if j < i or roots[j] == roots[i]:
                continue
            least, most = sorted((len(own), len(sets[j])))
            if least < similarity * most:
                continue
            shared = len(np.intersect1d(own, sets[j], assume_unique=True))
            if shared >= similarity * (least + most - shared):
                edges.append((nodes[i], nodes[j]))
                roots[roots == roots[j]] = roots[i]
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def covered_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(node, leader): candidates of the covering search over the fingerprints of ``classes`` (node, fp)."""
    heads = materialize(classes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = classes.join(heads, "fp").select("node", F.col("head").alias("leader"))
    near = near_edges(heads.select("fp", F.col("fp").alias("node")), radius)
    near = near.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("leader")), "u")
    near = near.join(heads.select(F.col("fp").alias("v"), F.col("head").alias("node")), "v")
    return equal.unionByName(near.select("node", "leader")).filter(F.col("node") != F.col("leader"))


def similar_groups(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, text_key, group): rows that chains of texts at ``similarity`` or more link share a group."""
    spark = docs.sparkSession
    prints = materialize(signatures(docs, words))
    classes = materialize(prints.groupBy("node").agg(F.min("text_key").alias("key"), F.min("fp").alias("fp"), *[F.min(b).alias(b) for b in _BAND_COLUMNS]))
    bands = F.array(*[F.struct(F.lit(i).alias("t"), F.col(b).alias("k")) for i, b in enumerate(_BAND_COLUMNS)])
    rows = classes.select("node", F.explode(bands).alias("x")).select(F.xxhash64("x.t", "x.k").alias("bucket"), "node")
    leaders = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter(F.col("size") > 1)
    # As in ``near_edges``: exploded rows look small to the planner, so the joins of both explodes are hinted.
    shared = materialize(rows.hint("merge").join(leaders, "bucket"))
    covered = covered_pairs(classes.select("node", "fp"), radius)
    pairs = materialize(covered.union(shared.filter(F.col("node") != F.col("leader")).select("node", "leader")).distinct())
    named = shared.select("node").union(pairs.select("node")).union(pairs.select("leader")).distinct()
    sets = materialize(sets_of(docs, classes.select("node", "key").join(named, "node", "left_semi"), words))

    compared = pairs.join(sets, "node").join(sets.select(F.col("node").alias("leader"), F.col("grams").alias("other")), "leader")
    edges = materialize(compared.filter(jaccard(F.col("grams"), F.col("other")) >= similarity).select(F.col("node").alias("u"), F.col("leader").alias("v")))
    roots = materialize(components(spark, edges))

    # Buckets that the edges to their smallest nodes have not made one.
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select("bucket", "node", "size", "root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    left = placed.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = (F.least("mine", "with") * F.col("blocks") + F.greatest("mine", "with")).cast("int").alias("part")
    left = left.select("bucket", part, "node", "root").hint("merge").join(sets, "node")
    more = materialize(left.groupBy("bucket", "part").applyInPandas(lambda rows: _across(rows, similarity), "u long, v long").distinct())
    if not more.isEmpty():
        roots = components(spark, edges.union(more))
    named = classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    return prints.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "group")


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (rows without an id come last)."""
    return keep_first(docs, similar_groups(docs, words, similarity))
