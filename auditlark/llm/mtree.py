"""Exact top-k search with M-trees.

Vectors of integers are compared by inner product, which is no metric. With
M >= every norm, the extra coordinate sqrt(M^2 - |x|^2) puts all vectors x on a
sphere of radius M, a query q keeps 0 there, and
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the nearest vectors are those of the largest
inner product, and the triangle inequality holds.

The vectors are cut into cells of about ``CELL`` vectors around pivots, and each
cell becomes one M-tree of paged nodes, stored as one row: every entry keeps its
distance to the parent's routing object, every node its covering radius. A search
opens nodes best first. From the stored distances alone,
|d(q, parent) - d(entry, parent)| - radius bounds the distance of everything under
an entry, so most distances are never computed. Pages are evaluated as arrays.

A query's k-th best score in a bounded sample of the candidates is a score its true k-th
best must reach. Blocks of queries meet packs of cell summaries (center, radius),
and a query goes only to the cells whose bound reaches that score. A task
then reads a cell once and searches it for one block of queries after the other.
Scores are exact integer products; distances in floating point only prune, with a
margin.

Equal vectors fold into one entry with their ``k + 1`` smallest ids, which is all
that any query can return of them, so copies cost nothing and ties go to the
smaller id.

Defined results: vectors that are null, hold null or non-finite components, or have
another length than the most frequent one do not take part; rows with a null id are neither
queries nor candidates; rows that repeat an id and vector count once, and a
query's own id is never its candidate; extra columns are not carried.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlark.session import materialize

#: Vectors of one cell, entries of one page, queries of one block, most pivots, cell summaries of one pack, vectors of the sample.
CELL = 4_096
PAGE = 128
BLOCK = 256
PIVOTS = 256
PACK = 512
SAMPLE = 2_048
#: Relative slack of floating-point distances.
SLACK = 1e-6


def lift(x: np.ndarray, norm: float, query: bool = False) -> np.ndarray:
    """Vectors with the extra coordinate of the sphere of radius ``norm`` (0 for queries)."""
    x = x.astype(np.float64)
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return np.column_stack([x, extra])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to the rows of ``b``."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


class MTree:
    """A bulk-loaded M-tree over distinct vectors.

    ``nodes``: per node (center, radius, first entry, last entry, is leaf); the entries
    of a leaf are rows of ``vectors``, those of an inner node are nodes. ``to_parent``
    holds each vector's distance to its leaf's center, ``node_to_parent`` each node's
    distance to its parent's center.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: float):
        self.vectors, self.ids, self.norm = vectors, ids, norm
        self.build()

    def build(self) -> None:
        points = lift(self.vectors, self.norm)
        order, leaves = self._leaves(points)
        self.vectors, self.ids, points = self.vectors[order], self.ids[order], points[order]
        centers = np.array([points[a:b].mean(0) for a, b in leaves])
        # The routing object is a vector of the page: the one nearest to its mean.
        routing = np.array([a + int(distances(points[a:b], c[None])[:, 0].argmin()) for (a, b), c in zip(leaves, centers)])
        self.to_parent = np.concatenate([distances(points[a:b], points[r][None])[:, 0] for (a, b), r in zip(leaves, routing)])
        center = [*routing]
        radius = [float(self.to_parent[a:b].max()) for a, b in leaves]
        span, leaf = [*leaves], [True] * len(leaves)
        to_parent = [0.0] * len(leaves)
        level = list(range(len(leaves)))
        while len(level) > 1:
            groups = self._groups(points[[center[i] for i in level]])
            above = []
            for group in groups:
                members = [level[i] for i in group]
                own = points[[center[i] for i in members]]
                c = center[members[int(distances(own, own.mean(0)[None])[:, 0].argmin())]]
                d = distances(own, points[c][None])[:, 0]
                for i, x in zip(members, d):
                    to_parent[i] = float(x)
                center.append(c)
                radius.append(float(max(x + radius[i] for i, x in zip(members, d))))
                span.append((members, None))
                leaf.append(False)
                to_parent.append(0.0)
                above.append(len(center) - 1)
            level = above
        self.root = level[0]
        self.center, self.radius, self.span, self.leaf = np.array(center), np.array(radius), span, leaf
        self.node_to_parent = np.array(to_parent)
        self.points = points

    @staticmethod
    def _groups(points: np.ndarray) -> list[np.ndarray]:
        """Pages of near points: halved along the two most distant of them until a page holds them."""
        done, open_ = [], [np.arange(len(points))]
        while open_:
            own = open_.pop()
            if len(own) <= PAGE:
                done.append(own)
                continue
            p = points[own]
            a = int(distances(p, p[:1])[:, 0].argmax())
            da = distances(p, p[a:a + 1])[:, 0]
            db = distances(p, p[int(da.argmax())][None])[:, 0]
            order = np.argsort(da - db, kind="stable")
            half = len(own) // 2
            open_ += [own[order[:half]], own[order[half:]]]
        return done

    def _leaves(self, points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        groups = self._groups(points)
        ends = np.cumsum([len(g) for g in groups])
        return np.concatenate(groups), [(int(e - len(g)), int(e)) for e, g in zip(ends, groups)]

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[list[tuple[int, int]], int]:
        """([(score, id)] best first, distances computed): at most ``k`` results of at least ``floor``."""
        q = lift(query[None], self.norm, query=True)
        square = float((q * q).sum()) + self.norm * self.norm
        slack = SLACK * (square + 1)
        best: list[tuple[int, int]] = []  # min-heap of (score, -id)
        bound = lambda d: (square - max(d, 0.0) ** 2) / 2 + slack  # noqa: E731  the largest score at distance d or more
        needed = lambda: max(-np.inf if floor is None else floor, best[0][0] if len(best) == k else -np.inf)
        computed = 1
        d_root = float(distances(q, self.points[self.center[self.root]][None])[0, 0])
        queue = [(d_root - self.radius[self.root], self.root, d_root)]
        while queue:
            low, node, d_node = heapq.heappop(queue)
            if bound(low) < needed():
                break  # all other nodes are at least as far
            if self.leaf[node]:
                a, b = self.span[node]
                least = np.abs(d_node - self.to_parent[a:b])
                near = a + np.flatnonzero((square - least * least) / 2 + slack >= needed())
                computed += len(near)
                scores = self.vectors[near] @ query
                for i in near[np.argsort(-scores, kind="stable")]:
                    score = int(self.vectors[i] @ query)
                    if score < needed():
                        break
                    for x in self.ids[i]:
                        x = int(x)
                        if x == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (score, -x))
                        elif (score, -x) > best[0]:
                            heapq.heapreplace(best, (score, -x))
                        else:
                            break  # ids ascend
                continue
            members = np.array(self.span[node][0])
            least = np.maximum(np.abs(d_node - self.node_to_parent[members]) - self.radius[members], 0)
            members = members[(square - least * least) / 2 + slack >= needed()]
            if len(members):
                computed += len(members)
                d = distances(q, self.points[self.center[members]])[0]
                for i, x in zip(members.tolist(), d.tolist()):
                    if bound(x - self.radius[i]) >= needed():
                        heapq.heappush(queue, (x - self.radius[i], i, x))
        return sorted(((s, -i) for s, i in best), key=lambda r: (-r[0], r[1])), computed

    def dump(self) -> bytes:
        out = io.BytesIO()
        flat = np.concatenate(self.ids) if len(self.ids) else np.zeros(0, np.int64)
        inner = [s[0] for s, leaf in zip(self.span, self.leaf) if not leaf]
        np.savez(
            out, vectors=self.vectors.astype(np.int32) if np.abs(self.vectors).max() < 1 << 31 else self.vectors, ids=flat, n_ids=[len(x) for x in self.ids], norm=self.norm, to_parent=self.to_parent, center=self.center,
            radius=self.radius, node_to_parent=self.node_to_parent, leaves=[s for s, leaf in zip(self.span, self.leaf) if leaf],
            inner=np.concatenate(inner) if inner else np.zeros(0, np.int64), n_inner=[len(x) for x in inner], root=self.root,
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as p:
            tree.vectors, tree.norm, tree.to_parent, tree.center = p["vectors"].astype(np.int64), float(p["norm"]), p["to_parent"], p["center"]
            tree.radius, tree.node_to_parent, tree.root = p["radius"], p["node_to_parent"], int(p["root"])
            tree.ids = np.array(np.split(p["ids"], np.cumsum(p["n_ids"])[:-1]) + [None], dtype=object)[:-1]
            leaves = [tuple(map(int, s)) for s in p["leaves"]]
            inner = [(x.tolist(), None) for x in np.split(p["inner"], np.cumsum(p["n_inner"])[:-1])] if len(p["n_inner"]) else []
        tree.span, tree.leaf = leaves + inner, [True] * len(leaves) + [False] * len(inner)
        tree.points = lift(tree.vectors, tree.norm)
        return tree


def fold(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct vectors, the ``keep`` smallest distinct ids of each, ascending)."""
    own, inverse = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort([ids, inverse.reshape(-1)])
    parts = np.split(ids[order], np.cumsum(np.bincount(inverse.reshape(-1)))[:-1])
    return own, np.array([np.unique(x)[:keep] for x in parts] + [None], dtype=object)[:-1]


def usable(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for rows that take part."""
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(F.coalesce(finite, F.lit(False)))
    found = found.select(F.col("vec_id").cast("long"), F.transform(doubles, lambda x: F.floor(scale * x)).alias("v"))
    return found


def build(vectors: DataFrame, k: int) -> DataFrame:
    """(cell, tree, center, radius, norm) of ``vectors`` (vec_id, v), written to the shared folder."""
    spark = vectors.sparkSession
    n = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(max(1, min(PIVOTS, n // CELL)))
    pivots = np.array([r.v for r in chosen.select("v").collect()], np.float64)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        p = shared.value
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.float64)
            near = ((p * p).sum(1)[None] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["vec_id", "v", "pivot"])

    near = materialize(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, pivot long"))
    # One count per pivot (at most PIVOTS rows) tells into how many cells its vectors go.
    sizes = {r.pivot: -(-r["count"] // CELL) for r in near.groupBy("pivot").count().collect()}
    cuts = F.array(*[F.lit(sizes.get(i, 1)) for i in range(len(pivots))])
    part = F.pmod(F.xxhash64("vec_id", "v"), F.element_at(cuts, F.col("pivot").cast("int") + 1))
    celled = near.withColumn("cell", F.col("pivot") + part * len(pivots))

    def cells(rows: pd.DataFrame) -> pd.DataFrame:
        own, ids = fold(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), k + 1)
        tree = MTree(own, ids, float(np.sqrt((own.astype(np.float64) ** 2).sum(1).max())))
        center = tree.vectors[tree.center[tree.root]]
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "tree": [tree.dump()], "center": [center], "radius": [tree.radius[tree.root]], "norm": [tree.norm]})

    schema = "cell long, tree binary, center array<long>, radius double, norm double"
    return materialize(celled.groupBy("cell").applyInPandas(cells, schema))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def query_blocks(queries: DataFrame, sample: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(block, queries): at most BLOCK queries as (id, key, floor, vector), packed."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        ids, vectors = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                own = batch.slice(a, BLOCK)
                q, v = own.column(0).to_numpy(), _matrix(own.column(1))
                scores = v @ vectors.T
                scores[q[:, None] == ids[None]] = np.iinfo(np.int64).min  # never its own candidate
                floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
                packed = _pack(q, own.column(2).to_numpy(), floor, v)
                yield pa.RecordBatch.from_pydict({"queries": pa.array([packed], pa.binary())})

    found = queries.select("vec_id", "v", F.xxhash64("v").alias("key")).distinct()
    return materialize(found.mapInArrow(run, "queries binary"))


def _pack(*parts: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *parts)
    return out.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as parts:
        return [parts[c] for c in parts.files]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner product for each query.

    Both inputs have (vec_id, v) with integer components; a query's own id is left out.
    """
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, key long, vec_id long, score long"
    if not lengths:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    vectors, queries = (df.filter(F.size("v") == lengths[0].n).select("vec_id", "v") for df in (vectors, queries))
    vectors = materialize(vectors)
    cells = build(vectors, k)
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).dropDuplicates().collect()
    sample = np.array([r.vec_id for r in drawn], np.int64), np.array([r.v for r in drawn], np.int64).reshape(len(drawn), -1)
    blocks = query_blocks(queries, sample, k)

    # Query blocks meet packs of cell summaries.
    packs = max(1, -(-cells.count() // PACK))
    summary = F.collect_list(F.struct("cell", "center", "radius", "norm")).alias("cells")
    packed = cells.withColumn("pack", F.pmod("cell", F.lit(packs))).groupBy("pack").agg(summary)
    asked = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(packed, "pack").select("queries", "cells")

    def route(batches):
        for batch in batches:
            for data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q, key, floor, v = _unpack(data)
                centers = np.array([c["center"] for c in found], np.float64)
                radius, norm = (np.array([c[x] for c in found]) for x in ("radius", "norm"))
                square = (v.astype(np.float64) ** 2).sum(1)[:, None] + norm[None] ** 2
                d = np.maximum(np.sqrt(np.maximum(square - 2 * (v @ centers.T), 0)) - radius[None], 0)
                reach = (square - d * d) / 2 + SLACK * (square + 1) >= floor[:, None]
                sent = [(c["cell"], _pack(q[r], key[r], floor[r], v[r])) for c, r in zip(found, reach.T) if r.any()]
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c for c, _ in sent], pa.int64()), "data": pa.array([x for _, x in sent], pa.binary())})

    sent = asked.mapInArrow(route, "cell long, data binary")
    # A cell's tree comes first, then its query blocks, one at a time.
    trees = cells.select("cell", F.lit(0).alias("kind"), F.col("tree").alias("data"))
    stream = trees.unionByName(sent.select("cell", F.lit(1).alias("kind"), "data")).repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches):
        tree = None
        for batch in batches:
            for kind, data in zip(batch.column(1), batch.column(2)):
                if kind.as_py() == 0:
                    tree = data.as_py()
                    continue
                tree = MTree.load(tree) if isinstance(tree, bytes) else tree
                out = []
                for q, key, floor, v in zip(*_unpack(data.as_py())):
                    found, _ = tree.search(v, int(q), k, int(floor))
                    out += [(int(q), int(key), i, s) for s, i in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["query_id", "key", "vec_id", "score"])

    found = stream.mapInArrow(run, schema)
    # At most k rows of each cell arrive for a query.
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
