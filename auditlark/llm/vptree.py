"""Approximate nearest neighbours with vantage-point trees per shard.

Nearness is the cosine. Vectors of length one have distance sqrt(2 - 2 cos), a
metric with the same order, so balls and shells around vantage points bound it:
a subtree whose members lie at distances [low, high] from its vantage point holds
nothing nearer to a query at distance d than max(d - high, low - d). A subtree is
left out when ``factor`` times that bound exceeds the query's k-th distance. Factor
one is exact search; a larger one leaves more out and may miss neighbours.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that a query
can return of them. Entries go to the nearest of at most ``PIVOTS`` pivots, crowded
pivots get up to ``PIVOTS`` pivots of their own, and what is still crowded is cut into
shells of equal size around its pivot; each shard of about ``SHARD`` entries becomes one tree,
stored as a row. A query is first answered by its own shard. With the k-th distance
found there it goes to the other shards that the bound of their centre and radius does
not rule out. Blocks of queries descend a tree together, each query nearer side first.

Defined results: vectors that are null, zero, hold null or non-finite components, or have
another length than the most frequent one take no part; rows with a null id are neither
queries nor candidates; rows that repeat an id and vector count once, a query's own id
is never its candidate; equal scores go to the smaller id; fewer than ``k`` candidates
are all returned; extra columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlark.session import materialize

#: Entries of one shard, of one leaf, most pivots of a level, queries of one block, shard summaries of one pack.
SHARD = 8_192
LEAF = 128
PIVOTS = 256
BLOCK = 256
PACK = 512
#: Relaxation of the bounds; the README states the recall measured with it.
FACTOR = 5.0
#: Slack of floating-point distances.
SLACK = 1e-9

_NO_ID = np.iinfo(np.int64).max


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to the rows of ``b``, all of length one."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class VPTree:
    """A vantage-point tree over distinct vectors, each with its ids.

    ``spans``: entries below each node; ``points``: its vantage point (-1 for a leaf);
    ``children`` and ``ranges``: the inner and outer side and the least and largest
    distance of their members from the vantage point.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        unit = units(vectors)
        order = np.arange(len(vectors))
        nodes: list[list] = []
        open_ = [(0, len(order), -1, 0)]
        while open_:
            a, b, parent, side = open_.pop()
            node = [a, b, -1, -1, -1, 0.0, 0.0, 0.0, 0.0]
            nodes.append(node)
            if parent >= 0:
                nodes[parent][3 + side] = len(nodes) - 1
            if b - a <= LEAF:
                continue
            # The most spread of a few members, told by their distances to a few others, sees the rest best.
            own = order[a:b]
            some = own[:: max(1, len(own) // 32)][:32]
            pick = a + int(np.flatnonzero(own == some[gaps(unit[some], unit[some]).std(1).argmax()])[0])
            order[a], order[pick] = order[pick], order[a]
            d = gaps(unit[order[a + 1:b]], unit[order[a]][None])[:, 0]
            by_distance = np.argsort(d, kind="stable")
            order[a + 1:b], d = order[a + 1:b][by_distance], d[by_distance]
            half = len(d) // 2
            node[2], node[5:] = a, [float(d[0]), float(d[half - 1]), float(d[half]), float(d[-1])]
            open_ += [(a + 1, a + 1 + half, len(nodes) - 1, 0), (a + 1 + half, b, len(nodes) - 1, 1)]
        self.vectors, self.ids = vectors[order], ids[order]
        table = np.array(nodes, np.float64).reshape(-1, 9)
        self.spans, self.points = table[:, :2].astype(np.int64), table[:, 2].astype(np.int64)
        self.children, self.ranges = table[:, 3:5].astype(np.int64), table[:, 5:].reshape(-1, 2, 2)
        self.unit = units(self.vectors)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(entries, cosines, distances computed): the ``k`` best entries of each query, -1 where there are fewer.

        ``own`` holds each query's id, ``reach`` the distance within which results still count.
        """
        q = units(queries)
        best = np.full((len(q), k), -1)
        score = np.full((len(q), k), -np.inf)
        smallest = np.full((len(q), k), _NO_ID)
        reach = reach.copy()
        computed = 0

        def take(rows: np.ndarray, a: int, b: int) -> None:
            nonlocal computed
            computed += len(rows) * (b - a)
            found = q[rows] @ self.unit[a:b].T
            ids = np.where(self.ids[a:b, 0][None] == own[rows][:, None], self.ids[a:b, 1][None], self.ids[a:b, 0][None])
            found[ids == _NO_ID] = -np.inf  # the query itself
            least = score[rows, -1]
            if b - a > k:
                least = np.maximum(least, np.partition(found, b - a - k, axis=1)[:, b - a - k])
            r, c = np.nonzero((found >= least[:, None]) & np.isfinite(found))
            changed = np.unique(r)
            if not len(changed):
                return
            old = rows[changed]
            row = np.concatenate([np.repeat(changed, k), r])
            scores, all_ids = np.concatenate([score[old].ravel(), found[r, c]]), np.concatenate([smallest[old].ravel(), ids[r, c]])
            place = np.concatenate([best[old].ravel(), a + c])
            order = np.lexsort((all_ids, -scores, row))
            first = np.searchsorted(row[order], changed)
            top = order[first[:, None] + np.arange(k)]
            score[old], smallest[old], best[old] = scores[top], all_ids[top], place[top]
            worst = score[old, -1]
            reach[old] = np.minimum(reach[old], np.where(np.isfinite(worst), np.sqrt(np.maximum(2 - 2 * worst, 0)), np.inf))

        def visit(node: int, rows: np.ndarray) -> None:
            nonlocal computed
            at = self.points[node]
            if at < 0:
                take(rows, *self.spans[node])
                return
            take(rows, at, at + 1)
            d = gaps(q[rows], self.unit[at:at + 1])[:, 0]
            ranges = self.ranges[node]
            bound = np.maximum(np.maximum(d[None] - ranges[:, 1:], ranges[:, :1] - d[None]), 0) * factor
            inner = d < (ranges[0, 1] + ranges[1, 0]) / 2
            for first, chosen in ((0, inner), (1, ~inner)):
                for side in (first, 1 - first):
                    near = rows[chosen & (bound[side] <= reach[rows] + SLACK)]
                    if len(near):
                        visit(int(self.children[node, side]), near)

        if len(q):
            visit(0, np.arange(len(q)))
        best[~np.isfinite(score)] = -1
        return best, score, computed

    def results(self, queries: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, cosine of the vectors as given): at most ``k`` a query."""
        best, _, _ = self.search(queries, own, k, reach, factor)
        row, place = np.nonzero(best >= 0)
        entry = best[row, place]
        x, y = queries[row], self.vectors[entry]
        cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        ids = self.ids[entry]
        usable = (ids != _NO_ID) & (ids != own[row][:, None])
        r, c = np.nonzero(usable)
        row, ids, cosine = row[r], ids[r, c], cosine[r]
        order = np.lexsort([ids, -cosine, row])
        row, ids, cosine = row[order], ids[order], cosine[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        rank = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)])) if len(row) else np.zeros(0, int)
        return row[rank < k], ids[rank < k], cosine[rank < k]

    def dump(self) -> bytes:
        return _pack(self.vectors, self.ids, self.spans, self.points, self.children, self.ranges)

    @classmethod
    def load(cls, data: bytes) -> VPTree:
        tree = cls.__new__(cls)
        tree.vectors, tree.ids, tree.spans, tree.points, tree.children, tree.ranges = _unpack(data)
        tree.unit = units(tree.vectors)
        return tree


def _pack(*parts: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *parts)
    return out.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as parts:
        return [parts[name] for name in parts.files]


def _mark(n: int) -> np.ndarray:
    return 1e4 * np.sin(np.arange(1, n + 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part; components stay as wide as they are and are computed on as doubles."""
    v = F.col(vector)
    kind = rows.schema[vector].dataType.simpleString()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    # Negative zeros equal zeros, also as grouping keys.
    return found.select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x + 0.0).cast(kind).alias("v"))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors, each with its ``k + 1`` smallest ids in order."""
    order = Window.partitionBy("v").orderBy("vec_id")
    least = vectors.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def nearest_pivot(rows: DataFrame, pivots: dict[int, np.ndarray], parent: str | None, out: str) -> DataFrame:
    """Add ``out``, the nearest of the pivots of each row's ``parent`` (or of all), and ``gap``, the distance to it.

    Where a parent has no pivots of its own, ``out`` is 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast({p: units(x) for p, x in pivots.items()})
    fields = [f for f in rows.schema.fields if f.name not in (out, "gap")]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", {out} long, gap double"

    def run(batches):
        known = shared.value
        for batch in batches:
            x = units(_matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, 1))
            group = batch.column(parent).to_numpy() if parent else np.zeros(len(x), np.int64)
            near, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
            for g in np.unique(group).tolist():
                if g in known:
                    own = group == g
                    d = gaps(x[own], known[g])
                    # Vectors at one distance are told apart below any bound that counts, so that shells can cut them.
                    near[own], gap[own] = d.argmin(1), d.min(1) + 1e-9 * (x[own] @ _mark(x.shape[1]) % 1)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(near), pa.array(gap)], [*names, out, "gap"])

    return rows.select(*names).mapInArrow(run, schema)


class Layout:
    """How vectors are dealt to shards: two levels of pivots, then shells."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        chosen = rows.orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, -(-n // SHARD)))).collect()
        self.first = {0: np.array([r.v for r in chosen], np.float64)}
        placed = nearest_pivot(rows, self.first, None, "area")
        sizes = placed.groupBy("area").count().collect()
        wanted = {r.area: min(PIVOTS, -(-r["count"] // SHARD)) for r in sizes if r["count"] > 2 * SHARD}
        self.second: dict[int, np.ndarray] = {}
        if wanted:
            limit = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("area"))
            order = Window.partitionBy("area").orderBy(F.xxhash64("v"), "v")
            drawn = placed.filter(F.col("area").isin(*wanted)).withColumn("place", F.row_number().over(order)).filter((F.col("place") <= PIVOTS) & (F.col("place") <= limit))
            found: dict[int, list] = {}
            for r in drawn.select("area", "v").toLocalIterator():
                found.setdefault(r.area, []).append(r.v)
            self.second = {area: np.array(x, np.float64) for area, x in found.items()}
        placed = materialize(nearest_pivot(placed, self.second or self.first, "area" if self.second else None, "spot"))
        # At most PIVOTS x PIVOTS rows; only shards still crowded are cut at quantiles of their distances.
        crowded = placed.groupBy("area", "spot").agg(F.count("*").alias("n"), F.percentile_approx("gap", [i / 64 for i in range(1, 64)]).alias("at"))
        self.shells = crowded.filter(F.col("n") > 2 * SHARD).withColumn("pieces", F.least(F.lit(64), F.ceil(F.col("n") / SHARD)).cast("int"))
        self.placed = self._shelled(placed)

    def place(self, queries: DataFrame) -> DataFrame:
        found = nearest_pivot(queries, self.first, None, "area")
        return self._shelled(nearest_pivot(found, self.second or self.first, "area" if self.second else None, "spot"))

    def _shelled(self, placed: DataFrame) -> DataFrame:
        cut = placed.join(self.shells.select("area", "spot", "at", "pieces"), ["area", "spot"], "left")
        # Of the 64 equal shells, neighbouring ones join into ``pieces``.
        inner = F.size(F.filter("at", lambda x: x < F.col("gap")))
        shell = F.coalesce(F.floor(inner * F.col("pieces") / 64), F.lit(0))
        return cut.withColumn("shard", (F.col("area") * PIVOTS + F.col("spot")) * 64 + shell).drop("area", "spot", "gap", "at", "pieces")


def build(layout: Layout, k: int) -> DataFrame:
    """(shard, tree, center, radius) of the dealt entries."""
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.full((len(rows), k + 1), _NO_ID)
        for i, own in enumerate(rows["ids"]):
            ids[i, :len(own)] = own
        tree = VPTree(np.stack(rows["v"].to_numpy()).astype(np.float64), ids)
        center = tree.unit.mean(0)
        radius = float(np.sqrt(((tree.unit - center) ** 2).sum(1)).max())
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "tree": [tree.dump()], "center": [center], "radius": [radius]})

    return materialize(layout.placed.groupBy("shard").applyInPandas(grow, "shard long, tree binary, center array<double>, radius double"))


_FOUND = "query_id long, key long, vec_id long, score double"


def ask(trees: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, key, vec_id, score) of ``asked`` (shard, data): blocks of queries meet the tree of their shard."""
    rows = trees.select("shard", F.lit(0).alias("kind"), F.col("tree").alias("data")).unionByName(asked.select("shard", F.lit(1).alias("kind"), "data"))
    # A shard's tree comes first, then its blocks of queries, one at a time.
    stream = rows.repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches):
        tree = None
        for batch in batches:
            for kind, data in zip(batch.column(1), batch.column(2)):
                if kind.as_py() == 0:
                    tree = data.as_py()
                    continue
                tree = VPTree.load(tree) if isinstance(tree, bytes) else tree
                q, key, reach, v = _unpack(data.as_py())
                row, ids, cosine = tree.results(v, q, k, reach, factor)
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(key[row]), pa.array(ids), pa.array(cosine)], ["query_id", "key", "vec_id", "score"])

    return stream.mapInArrow(run, _FOUND)


def home_blocks(queries: DataFrame) -> DataFrame:
    """(shard, data): the queries (vec_id, key, v, shard) of each shard in blocks."""
    def run(batches):
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            q, key, v = batch.column("vec_id").to_numpy(), batch.column("key").to_numpy(), _matrix(batch.column("v"))
            out = []
            for s in np.unique(shards):
                own = np.flatnonzero(shards == s)
                out += [(int(s), _pack(q[p], key[p], np.full(len(p), np.inf), v[p])) for p in np.split(own, range(BLOCK, len(own), BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], ["shard", "data"])

    # A crowded shard's queries may lie in several tasks.
    return queries.sortWithinPartitions("shard").mapInArrow(run, "shard long, data binary")


def far_blocks(queries: DataFrame, trees: DataFrame, factor: float) -> DataFrame:
    """(shard, data): blocks of queries (vec_id, key, v, shard, reach) for the shards besides their own that the bounds leave."""
    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                own = batch.slice(a, BLOCK)
                q, key, shard, reach = (own.column(c).to_numpy() for c in ("vec_id", "key", "shard", "reach"))
                yield pa.RecordBatch.from_pydict({"queries": pa.array([_pack(q, key, shard, reach, _matrix(own.column("v")))], pa.binary())})

    blocks = materialize(queries.select("vec_id", "key", "v", "shard", "reach").mapInArrow(pack, "queries binary"))
    packs = max(1, -(-trees.count() // PACK))
    summary = F.collect_list(F.struct("shard", "center", "radius")).alias("shards")
    packed = trees.withColumn("pack", F.pmod(F.xxhash64("shard"), F.lit(packs))).groupBy("pack").agg(summary)
    met = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).join(packed, "pack").select("queries", "shards")

    def route(batches):
        for batch in batches:
            for data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q, key, home, reach, v = _unpack(data)
                centers, radius = np.array([s["center"] for s in found]), np.array([s["radius"] for s in found])
                u = units(v)
                d = np.sqrt(np.maximum(1 + (centers * centers).sum(1)[None] - 2 * (u @ centers.T), 0))
                near = factor * np.maximum(d - radius[None], 0) <= reach[:, None] + SLACK
                sent = []
                for s, rows in zip(found, near.T):
                    rows = rows & (home != s["shard"])
                    if rows.any():
                        sent.append((s["shard"], _pack(q[rows], key[rows], reach[rows], v[rows])))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sent], pa.int64()), pa.array([x for _, x in sent], pa.binary())], ["shard", "data"])

    return met.mapInArrow(route, "shard long, data binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` rows of ``vectors`` with the largest cosine for each query, exactly these at factor 1.

    Both inputs are (vec_id, v) as ``usable`` gives them.
    """
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors, queries = (df.filter(F.size("v") == lengths[0].n).select("vec_id", "v") for df in (vectors, queries))
    layout = Layout(materialize(entries(vectors, k)))
    trees = build(layout, k)
    asked = materialize(layout.place(queries.distinct().withColumn("key", F.xxhash64("v"))))
    near = materialize(ask(trees, home_blocks(asked), k, factor))
    # A query with k results at home needs nothing farther than the worst of them.
    worst = near.groupBy("query_id", "key").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    told = worst.select(F.col("query_id").alias("vec_id"), "key", reach.alias("reach"))
    bounded = asked.join(told, ["vec_id", "key"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    far = ask(trees, far_blocks(bounded, trees, factor), k, factor)
    # At most k rows of each shard arrive for a query.
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
