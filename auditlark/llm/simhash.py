"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is the 64-bit majority of the XXH64 hashes of a text's word
shingles. Covering LSH draws one random vector in F_2^(r+1) per bit; table v
(each non-zero vector of F_2^(r+1)) keeps the bits whose vector has an odd inner
product with v. Two fingerprints that differ in at most r bits span at most r of
these vectors, so some v is orthogonal to all of them and both collide in
table v. No pair is missed, whatever the draw.

Rows are never compared as pairs. Copies fold into one row per distinct
fingerprint first. Inside a bucket a breadth-first search over the distinct
fingerprints returns one edge per reached fingerprint, so a bucket of m gives at
most m - 1 edges. A bucket larger than ``BLOCK`` is cut into blocks and each pair
of blocks is searched as a task of its own. Components come from star
contraction over these edges.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other text; rows with a null id take part in the links but never name a
component (a component without any id is null); repeated rows each get a row;
extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlark.session import materialize

from .texts import text_key, tidy

BITS = 64
#: Distinct fingerprints of one bucket that are searched in one piece.
BLOCK = 8_192
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
SEED = 42

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle (``words`` words joined by a space), in chunks."""
    parts = text.lower().split()  # on bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(words, len(parts)) - 1
    starts, ends = starts[:len(starts) - last], ends[last:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for a in range(0, len(starts), CHUNK):
        pairs = zip(starts[a:a + CHUNK].tolist(), ends[a:a + CHUNK].tolist())
        yield np.fromiter((digest(view[s:e], SEED) for s, e in pairs), np.uint64, min(CHUNK, len(starts) - a))


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    counts, total = np.zeros(BITS, np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    bits = np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)
    return int(bits[0]) if total else 0


def fingerprint(text: bytes, words: int) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = pc.cast(pc.fill_null(batch.column(2), ""), pa.large_binary())
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return narrow.mapInArrow(tidy(run), "doc_id long, text_key long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs; within ``radius`` some mask hides every differing bit."""
    drawn = np.random.default_rng(seed).integers(1, 1 << (radius + 1), BITS)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.array([bin(int(x) & v).count("1") & 1 for x in drawn], np.uint8)
        masks.append(int(np.packbits(odd, bitorder="little").view(np.int64)[0]))
    return masks


def _distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return _BYTE_BITS[(a ^ b).view(np.uint8)].reshape(-1, 8).sum(1)


def spanning_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) as positions: a forest that links what chains of near fingerprints link.

    Each step compares one reached fingerprint with those not yet reached, so a
    dense bucket costs a few passes and a search ends as soon as all are reached.
    """
    left, sources, targets = np.arange(len(fps)), [], []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            at = queue.pop()
            near = _distance(fps[left], fps[at]) <= radius
            reached = left[near]
            if len(reached):
                queue.extend(reached.tolist())
                sources.append(np.full(len(reached), root))
                targets.append(reached)
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(sources), np.concatenate(targets)) if sources else (empty, empty)


def _bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, part, node, fp) sorted by bucket and part; a bucket's rows may span batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def found(keys, parts, nodes, fps):
        edge = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(keys)]])
        big = np.flatnonzero(np.diff(cuts) > 1)
        a, b = [], []
        for i in big:
            own = slice(cuts[i], cuts[i + 1])
            s, t = spanning_edges(fps[own].view(np.uint64), radius)
            a.append(nodes[own][s])
            b.append(nodes[own][t])
        flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
        keys, parts = held[-1][0], held[-1][1]
        if not len(keys):
            held.pop()
            continue
        # All groups but the last one are complete.
        last = int(np.flatnonzero((keys != keys[-1]) | (parts != parts[-1]))[-1]) + 1 if ((keys != keys[-1]) | (parts != parts[-1])).any() else 0
        if last:
            rows = tuple(np.concatenate([h[i] for h in held[:-1]] + [held[-1][i][:last]]) for i in range(4))
            held = [tuple(x[last:] for x in held[-1])]
            yield found(*rows)
    if held:
        yield found(*(np.concatenate([h[i] for h in held]) for i in range(4)))


def near_edges(classes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(u, v) over ``classes`` (fp, node): a spanning forest of each bucket of each table."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), (F.col("fp").bitwiseAND(F.lit(m))).alias("k")) for i, m in enumerate(covering_masks(radius))])
    rows = classes.select("fp", "node", F.explode(tables).alias("x")).select(F.xxhash64("x.t", "x.k").alias("bucket"), "fp", "node")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    # The planner does not count what explode adds: the rows, 31 for each class, would look small enough to broadcast.
    rows = rows.hint("merge").join(sizes, "bucket")
    # A bucket of up to ``block`` rows is one part. A larger one is cut into n blocks by node
    # and every pair of blocks is a part, so any two rows meet in one.
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0))))
    parted = (
        rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", other)
        .select(
            "bucket",
            (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("int").alias("part"),
            "node", "fp",
        )
    )
    parted = parted.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")
    return parted.mapInArrow(tidy(lambda batches: _bucket_edges(batches, radius)), "u long, v long").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that chains of ``edges`` (u, v) reach, for every node of an edge.

    Alternating star contraction: large-star hangs every larger neighbour of a node
    on the node's smallest neighbour, small-star does so with the smaller ones. Both
    use one partially aggregated minimum and a join that adaptive execution can
    split, so a hub with very many neighbours is never one group. Each round is
    written to the shared folder, which cuts the lineage.
    """
    edges = materialize(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter(F.col("u") != F.col("v")).distinct())
        # Here v < u on every row.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter(F.col("u") != F.col("v")).distinct())
        # A star forest is the fixed point; the sums change with every other step.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, text_key, fp (signed long), component_id (smallest doc_id of its group) and group.

    ``group`` names the component also where no member has an id.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, words))
    # A node is a distinct fingerprint; its number is the fingerprint itself, so null ids need no care.
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = materialize(classes.withColumn("node", F.col("fp")))
    roots = components(spark, near_edges(classes, radius))
    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(ids, "root").select("fp", "component_id", F.col("root").alias("group"))
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "component_id", "group")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (rows without an id come last)."""
    return keep_first(docs, near_duplicates(docs, words, radius))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of ``found`` (doc_id, text_key, group); null ids come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("first")
    winners = found.groupBy("group").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    keyed = docs.withColumn("_text_key", text_key())
    same = keyed["doc_id"].cast("long").eqNullSafe(winners["_id"]) & (keyed["_text_key"] == winners["_key"])
    # Repeated rows share id and text; one of them is enough.
    return keyed.join(winners, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")


def fingerprint_hex() -> F.Column:
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))
