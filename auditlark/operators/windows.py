"""Ordered work that stays linear and parallel when one key holds most rows.

A plain ``Window.partitionBy(key)`` sends a hot key to one task, and a sliding
frame re-reads its rows for every output row. The helpers here avoid both:

* ``find_slices`` names the keys that hold more than one task's share, by a mergeable
  sketch of heavy hitters in one pass, and cuts them at quantiles of their own times.
* ``running_totals`` adds pre-aggregated totals of earlier slices to the running sums
  inside a slice, so "all history before this row" needs no task that sees a hot key whole.
* ``sliding_state`` turns a time window into +1/-1 marks and is a prefix scan over
  them: counts, last-seen times and open expiries are handed from slice to slice, so
  slices may be far shorter than the window.
* ``row_blocks`` cuts a ranked sequence into blocks of bounded size with a
  fixed overlap, for operators that look a fixed number of rows back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000

# A key with fewer rows is never cut.
HOT_ROWS = 200_000
# Most keys that are cut, and most slices of a key.
HOT_KEYS = 4_096
GRID = 256
# Rows of a task that keeps running state; more rows make more tasks.
TASK_ROWS = 100_000


def floor_div(value: Column, by: int) -> Column:
    """Integer floor division (also right for negative values)."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("long")


@dataclass(frozen=True)
class Over:
    """Counts members of ``column`` that appear more than ``limit`` times in the window."""

    column: str
    limit: int


@dataclass(frozen=True)
class Total:
    """A running sum of ``weight`` within the entity and the ``by`` columns."""

    weight: Column
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Slices:
    """The hot keys (hashes of ``keys``) and the times, ascending, at which their slices begin; ``rows`` of all keys."""

    keys: tuple[str, ...]
    borders: dict[int, list[int]]
    rows: int = 0

    @property
    def part(self) -> list[str]:
        """What a task's rows have in common."""
        return [*self.keys, "_slice"] if self.borders else list(self.keys)

    def cut(self, df: DataFrame, ts: str) -> DataFrame:
        """Add ``_slice``: 0 for other keys, from 1 on for hot ones. Rows of one instant stay together."""
        if not self.borders:
            return df.withColumn("_slice", F.lit(0))
        # At most HOT_KEYS rows of at most GRID times.
        known = F.broadcast(df.sparkSession.createDataFrame(list(self.borders.items()), "_h long, _borders array<long>"))
        at = F.size(F.filter("_borders", lambda b: b <= F.col(ts))) + 1
        hashed = df.drop("_slice").withColumn("_h", F.xxhash64(*self.keys)).join(known, "_h", "left")
        return hashed.withColumn("_slice", F.when(F.col("_borders").isNotNull(), at).otherwise(0)).drop("_h", "_borders")


def find_slices(df: DataFrame, keys: Sequence[str], ts: str = "ts_us", hot_rows: int | None = None) -> Slices:
    """One pass for the keys with more than a task's share of the rows, and one over their rows alone for the borders.

    Keys that the sketch misses have a smaller share than its error, a sixteenth of
    a task's; they stay whole, which costs time but changes no result.
    """
    spark = df.sparkSession
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), HOT_KEYS)
    key = F.xxhash64(*keys)
    sketch = F.expr(f"approx_top_k(_h, {tasks}, {max(1024, 64 * tasks)})")
    top, n = df.select(key.alias("_h")).agg(sketch, F.count("*")).first()
    pieces = {r["item"]: min(GRID, -(-2 * r["count"] * tasks // n)) for r in top or () if r["count"] > max(hot_rows, n // tasks)}
    if not pieces:
        return Slices(tuple(keys), {}, n)
    grid = F.percentile_approx(ts, [i / GRID for i in range(1, GRID)], 10 * GRID)
    found = df.select(key.alias("_h"), ts).where(F.col("_h").isin(*pieces)).groupBy("_h").agg(grid.alias("at")).collect()
    return Slices(tuple(keys), {r["_h"]: sorted({r["at"][i * GRID // pieces[r["_h"]] - 1] for i in range(1, pieces[r["_h"]])}) for r in found}, n)


def spread(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Deal ``df`` to tasks by ``columns``, in so many that a task's share does not grow with ``rows``.

    Adaptive execution merges partitions by compressed bytes, of which narrow rows have few
    for the memory they take sorted; it leaves a given number alone.
    """
    if rows <= TASK_ROWS:
        return df.repartition(*columns)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(default, -(-rows // TASK_ROWS)), *columns)


def carried(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], k: int, *, back: bool = False, into: DataFrame | None = None
) -> DataFrame:
    """For each (group, slice) of ``into``, the ``k`` hot ``rows`` nearest before it (after it with ``back``), as rows of that slice.

    ``into`` are the rows' own slices unless it is given. Only the ``k`` outermost rows of each slice are ever compared.
    """
    group = list(group)
    sign = F.asc if back else F.desc
    edge = Window.partitionBy(*group, "_slice").orderBy(*[sign(c) for c in order])
    ends = rows.withColumn("_e", F.row_number().over(edge)).where(F.col("_e") <= k).drop("_e").withColumn("_real", F.lit(1))
    slots = (ends if into is None else into).select(*group, "_slice").distinct().withColumn("_real", F.lit(0))
    away = F.desc if back else F.asc
    along = Window.partitionBy(*group).orderBy(away("_slice"), "_real", *[away(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(slots, allowMissingColumns=True).withColumn("_i", F.sum("_real").over(along))
    places = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_i") - k + 1), F.col("_i"))
    wanted = both.where("_real = 0 AND _i > 0").select(*group, F.col("_slice").alias("_to"), F.explode(places).alias("_i"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "_i")]
    met = both.where("_real = 1").alias("l").join(wanted.alias("r"), same)
    return met.select(*[F.col(f"l.{c}") for c in rows.columns if c != "_slice"], F.col("r._to").alias("_slice"))


def _seed_rows(rows: DataFrame, entity: list[str], totals: Mapping[str, Total]) -> DataFrame:
    """Totals of all earlier slices, one row per slice and value of each ``by`` set."""
    dims = sorted({d for t in totals.values() for d in t.by})
    sets = sorted({t.by for t in totals.values()})
    group_cols = [*entity, "_slice", *dims]
    seeds = rows.groupingSets(
        [[F.col(c) for c in (*entity, "_slice", *by)] for by in sets], *[F.col(c) for c in group_cols]
    ).agg(F.grouping_id().alias("_set"), *[F.sum(f"_w_{m}").alias(f"_w_{m}") for m in totals])
    earlier = (
        Window.partitionBy("_set", *entity, *dims).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )

    def set_id(by: tuple[str, ...]) -> int:
        return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in by)

    weights = [
        F.when(F.col("_set") == set_id(t.by), F.sum(f"_w_{m}").over(earlier)).otherwise(0).alias(f"_w_{m}")
        for m, t in totals.items()
    ]
    filled = F.coalesce(F.greatest(*[F.abs(F.coalesce(F.col(f"_w_{m}"), F.lit(0))) for m in totals], F.lit(0)) > 0, F.lit(False))
    return seeds.select(*group_cols, *weights).where(filled).withColumn("_is_row", F.lit(0))


def running_totals(
    df: DataFrame,
    entity: Sequence[str],
    totals: Mapping[str, Total],
    *,
    hot_rows: int | None = None,
    slices: Slices | None = None,
    peers: bool = False,
    ts: str = "ts_us",
    tie: str = "event_id",
) -> DataFrame:
    """Inclusive running sums per row in ``(ts, tie)`` order within ``entity``; with ``peers``, rows of equal order share one sum.

    Sums of earlier slices arrive as seed rows in the same partition as the
    rows they apply to, so one exchange on (entity, slice) is enough. ``slices`` are looked for unless they are given.
    """
    columns = df.columns
    entity = list(entity)
    slices = slices or find_slices(df, entity, ts, hot_rows)
    weights = [t.weight.cast("long").alias(f"_w_{m}") for m, t in totals.items()]
    rows = slices.cut(df, ts).select("*", *weights).withColumn("_is_row", F.lit(1))
    if slices.borders:
        rows = rows.unionByName(_seed_rows(rows.where("_slice > 0"), entity, totals), allowMissingColumns=True)
    rows = spread(rows, slices.rows, *slices.part)
    sums = []
    for m, t in totals.items():
        w = Window.partitionBy(*slices.part, *t.by).orderBy("_is_row", ts, tie)
        frame = w.rangeBetween if peers else w.rowsBetween
        sums.append(F.sum(F.coalesce(F.col(f"_w_{m}"), F.lit(0))).over(frame(Window.unboundedPreceding, 0)).alias(m))
    return rows.select("*", *sums).where("_is_row = 1").select(*columns, *totals)


def sliding_state(
    df: DataFrame,
    keys: Sequence[str],
    window_s: int,
    *,
    distinct: Mapping[str, str] | None = None,
    over: Mapping[str, Over] | None = None,
    first: bool = False,
    nth: int | None = None,
    hot_rows: int | None = None,
    ts: str = "ts_us",
    tie: str = "event_id",
) -> DataFrame:
    """Window state per row over ``[ts - window_s, ts]`` within ``keys``.

    Adds ``n`` (rows in the window), one column per ``distinct`` entry (distinct
    values of a column), one per ``over`` entry, and on request ``first_us``
    (oldest row) and ``nth_us`` (the ``nth`` oldest row). Rows with equal time
    are in each other's window.

    A hot key is cut at quantiles of its times, whatever the window. What a slice must
    know of the others arrives as extra rows: the last rows of each member (for
    ``distinct`` and ``over``), the next rows and expiries (for ``nth`` and ``first``), and the sums of all
    earlier marks.
    """
    keys = list(keys)
    distinct = dict(distinct or {})
    over = dict(over or {})
    window_us = window_s * US
    columns = df.columns
    slices = find_slices(df, keys, ts, hot_rows)
    part = slices.part
    rows = slices.cut(df, ts).withColumn("_guest", F.lit(None).cast("string"))
    members = {c: max([1, *[r.limit for r in over.values() if r.column == c]]) for c in [*distinct.values(), *[r.column for r in over.values()]]}
    if slices.borders:
        hot = rows.where("_slice > 0")
        guests = [carried(hot, [*keys, c], [ts, tie], k).withColumn("_guest", F.lit(c)) for c, k in members.items()]
        if nth and nth > 1:
            guests.append(carried(hot, keys, [ts, tie], nth - 1, back=True).withColumn("_guest", F.lit("")))
        for g in guests:
            rows = rows.unionByName(g)
    # One exchange serves every window below: they all cluster on these columns.
    rows = rows.repartition(*part)

    def among(*own: str, guest: str) -> Window:
        # Guests of another purpose keep to themselves.
        others = [F.coalesce(F.col("_guest") != guest, F.lit(False))] if slices.borders else []
        return Window.partitionBy(*part, *own, *others).orderBy(ts, tie)

    for name, column in distinct.items():
        rows = rows.withColumn(f"_p_{name}", F.lag(ts).over(among(column, guest=column)))
    for name, rule in over.items():
        rows = rows.withColumn(f"_k_{name}", F.lag(ts, rule.limit).over(among(rule.column, guest=rule.column)))
    rows = rows.withColumn("_nth", F.lead(ts, nth - 1).over(among(guest="")) if nth else F.lit(None).cast("long"))
    rows = rows.where("_guest IS NULL").drop("_guest")

    zero = F.lit(0)
    names = ["n", *distinct, *over]

    def mark(at: Column, kind: int, deltas: dict[str, Column]) -> Column:
        fields = [at.alias("at"), F.lit(kind).alias("kind")]
        return F.struct(*fields, *[deltas.get(m, zero).cast("long").alias(f"d_{m}") for m in names])

    # A row leaves after the window; a member's last leave counts, so a row undoes the leave of the one before it.
    enter, leave, marks = {"n": F.lit(1)}, {"n": F.lit(-1)}, []
    for name in distinct:
        again = F.coalesce(F.col(f"_p_{name}") >= F.col(ts) - window_us, F.lit(False))
        enter[name] = F.when(again, 0).otherwise(1)
        leave[name] = F.lit(-1)
        marks.append(F.when(again, mark(F.col(f"_p_{name}") + window_us, 2, {name: F.lit(1)})))
    for name in over:
        back = F.col(f"_k_{name}")
        hit = F.coalesce(back >= F.col(ts) - window_us, F.lit(False))
        enter[name] = F.when(hit, 1).otherwise(0)
        marks.append(F.when(hit, mark(back + window_us, 2, {name: F.lit(-1)})))
    marks = [mark(F.col(ts), 0, enter), mark(F.col(ts) + window_us, 1, leave), *marks]
    # Only what enters is a row of the result; other marks carry no more than keys and times.
    wide = [c for c in columns if c not in (*keys, ts, tie)]
    timeline = rows.withColumn("_m", F.explode(F.array_compact(F.array(*marks)))).select(
        *keys, ts, tie, "_nth", F.col("_m.at").alias("_at"), F.least(F.col("_m.kind"), F.lit(1)).alias("_order"), F.col("_m.kind").alias("_kind"),
        *[f"_m.d_{m}" for m in names], *[F.when(F.col("_m.kind") == 0, F.col(c)).alias(c) for c in wide],
    )
    totals = {m: Total(F.col(f"d_{m}")) for m in names}
    state = running_totals(timeline, keys, totals, slices=slices, peers=True, ts="_at", tie="_order")
    extra: list[str] = []
    if first or nth:
        # The next expiry after a row belongs to the oldest row of its window;
        # reading the timeline backwards makes it the last expiry seen.
        state = slices.cut(state, "_at").withColumn("_guest", F.lit(None).cast("string"))
        if slices.borders:
            hot = state.where("_slice > 0")
            guests = carried(hot.where("_kind = 1"), keys, ["_at", tie], 1, back=True, into=hot)
            state = state.unionByName(guests.withColumn("_guest", F.lit("")))
        backwards = Window.partitionBy(*part).orderBy(F.desc("_at"), F.desc("_order"), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
        expiry = F.when(F.col("_kind") == 1, F.struct(F.col(ts).alias("first_us"), F.col("_nth").alias("nth_us")))
        state = state.withColumn("_old", F.last(expiry, ignorenulls=True).over(backwards)).where("_guest IS NULL")
        state = state.withColumn("first_us", F.col("_old.first_us")).withColumn("nth_us", F.col("_old.nth_us"))
        extra = ["first_us", "nth_us"] if nth else ["first_us"]
    return state.where("_kind = 0").select(*columns, *names, *extra)


def row_blocks(df: DataFrame, rank: str, size: int, overlap: int) -> DataFrame:
    """Cut a 1-based ``rank`` into blocks of ``size`` rows, each preceded by ``overlap`` copies.

    Adds ``block`` and ``is_copy``; a group of (key, block) holds at most
    ``size + overlap`` rows whatever the key.
    """
    if overlap > size:
        raise ValueError("overlap must not exceed the block size")
    at = F.col(rank) - 1
    own = floor_div(at, size)
    return df.withColumn("_own", own).withColumn(
        "block", F.explode(F.sequence("_own", floor_div(at + overlap, size)))
    ).withColumn("is_copy", F.col("block") > F.col("_own")).drop("_own")


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    scan: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run ``scan`` over rows that arrive group by group, in order.

    One pass over sorted partitions: a group costs no more than its rows, and
    no group is ever held in memory.
    """
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(scan, schema)


def group_starts(pdf: pd.DataFrame, group: Sequence[str], last: tuple | None) -> tuple[list[bool], tuple | None]:
    """Which rows of a sorted batch begin a new group, given the last row of the batch before."""
    if pdf.empty:
        return [], last
    changed = np.zeros(len(pdf), dtype=bool)
    for column in group:
        values = pdf[column].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    first, end = tuple(pdf[list(group)].iloc[0]), tuple(pdf[list(group)].iloc[-1])
    changed[0] = first != last
    return changed.tolist(), end


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key; Spark prunes to one candidate per key before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
