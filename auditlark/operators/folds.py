"""Ordered folds as composable maps: case state and alert suppression.

A fold reads a sequence in order and cannot be a window frame. Both folds here
have a small summary of any stretch of the sequence: for case state, which state each
start state ends in; for suppression, which alert is sent last for each alert that can be
sent first. Summaries compose, so stretches are reduced apart from each other, chained, and
replayed from their known starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as R
from .windows import Slices, Total, find_slices, floor_div, row_blocks, running_totals, US

#: Blocks of a case that are chained in one window partition where the case is hot.
CHAINED = 256


def case_transitions(steps: DataFrame, *, block_rows: int = 256, hot_rows: int | None = None) -> DataFrame:
    """Replay requested status changes; an illegal step leaves the state untouched.

    ``steps`` has ``case_id, ts_us, event_id, to_status``. Adds ``step``, ``from_status``,
    ``legal`` and ``status`` (after the step).

    A step is a map of states, and so is a block of steps. The maps before a block give its
    start, and the block is replayed from there. Blocks of hot cases are
    chained in two levels, with only the maps in the upper one.
    """
    states = R.CASE_STATES
    n, allowed = len(states), set(R.CASE_TRANSITIONS)
    # Row s, column t: the state after a step from s to t; the last column is an unknown target.
    after = F.array(*[F.lit(t if t < n and (states[s], states[t]) in allowed else s) for s in range(n) for t in range(n + 1)])
    name = lambda s: F.element_at(F.array(*map(F.lit, states)), s + 1)
    move = lambda s, t: F.element_at(after, s * (n + 1) + t + 1)
    through = lambda s, m: F.element_at(m, s + 1)
    identity = F.array(*map(F.lit, range(n)))

    slices = find_slices(steps, ["case_id"], hot_rows=hot_rows)
    ranked = running_totals(steps, ["case_id"], {"step": Total(F.lit(1))}, slices=slices)
    place = F.array_position(F.array(*map(F.lit, states)), F.col("to_status"))
    target = F.when(place > 0, (place - 1).cast("int")).otherwise(n)
    row = F.struct("step", target.alias("to"), *[F.col(c) for c in steps.columns])
    blocks = ranked.groupBy("case_id", floor_div(F.col("step") - 1, block_rows).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = blocks.withColumn("map", F.aggregate("rows", identity, lambda m, r: F.transform(m, lambda s: move(s, r.to))))
    chain = ["case_id"]
    opening = F.lit(0)
    if slices.borders:
        chain = ["case_id", "part"]
        blocks = blocks.withColumn("part", floor_div(F.col("block"), CHAINED))
        ordered = F.array_sort(F.collect_list(F.struct("block", "map")))
        whole = F.aggregate(ordered, identity, lambda m, b: F.transform(m, lambda s: through(s, b["map"])))
        parts = blocks.groupBy(*chain).agg(whole.alias("map"))
        earlier = Window.partitionBy("case_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.withColumn("opening", F.aggregate(F.collect_list("map").over(earlier), F.lit(0), through)).drop("map")
        blocks = blocks.join(starts, chain)
        opening = F.col("opening")
    before = Window.partitionBy(*chain).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("maps", F.collect_list("map").over(before))
    start = F.aggregate("maps", opening, through)
    result = lambda s, r: F.struct(
        *[r[c].alias(c) for c in (*steps.columns, "step")], name(s).alias("from_status"),
        (move(s, r.to) != s).alias("legal"), name(move(s, r.to)).alias("status"),
    )
    kinds = ranked.select(*steps.columns, "step").schema
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in kinds)
    none = F.array().cast(f"array<struct<{fields},from_status:string,legal:boolean,status:string>>")
    step = lambda a, r: F.struct(move(a.state, r.to).alias("state"), F.concat(a.out, F.array(result(a.state, r))).alias("out"))
    replayed = F.aggregate("rows", F.struct(start.alias("state"), none.alias("out")), step, lambda a: a.out)
    return blocks.select(F.inline(replayed))


def transition_audit(steps: DataFrame) -> DataFrame:
    """Plain check of each step against the step before it, without replay."""
    ranked = running_totals(steps, ["case_id"], {"step": Total(F.lit(1))})
    blocks = row_blocks(ranked, "step", 50_000, 1)
    w = Window.partitionBy("case_id", "block").orderBy("step")
    before = F.coalesce(F.lag("to_status").over(w), F.lit("open"))
    pairs = F.concat_ws(">", F.col("before"), "to_status").isin(*[f"{a}>{b}" for a, b in R.CASE_TRANSITIONS])
    return blocks.withColumn("before", before).withColumn("legal", pairs).where("NOT is_copy").drop("block", "is_copy")


def _changes(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Which rows of a sorted batch differ from the row before; the first one is false."""
    out = np.zeros(batch.num_rows, bool)
    for c in columns:
        left, right = batch.column(c)[:-1], batch.column(c)[1:]
        differ = pc.or_(pc.fill_null(pc.not_equal(left, right), False), pc.xor(left.is_null(), right.is_null()))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _send(seconds: np.ndarray, first: np.ndarray, sent_at: np.ndarray, window_s: int) -> np.ndarray:
    """Rows to send of sorted runs that begin at ``first``, given when each run sent last (a very small number: never).

    All runs advance together, one sent row at a time.
    """
    ends = np.append(first[1:], len(seconds))
    run = np.repeat(np.arange(len(first)), ends - first)
    # Runs are laid out one after the other, farther apart than any window.
    low = seconds.min()
    span = int(seconds.max() - low) + window_s + 2
    line = (seconds - low) + run * span
    following = np.minimum(np.searchsorted(line, line + window_s, side="right"), ends[run])
    free = np.clip(sent_at + window_s - low, -1, span - 1) + np.arange(len(first)) * span
    at = np.maximum(np.searchsorted(line, free, side="right"), first)
    sent = np.zeros(len(seconds), bool)
    at, stop = at[at < ends], ends[at < ends]
    while len(at):
        sent[at] = True
        at = following[at]
        at, stop = at[at < stop], stop[at < stop]
    return sent


_NEVER = -(1 << 60)


def _slice_map(rows: pd.DataFrame, window_s: int) -> tuple[list[int], list[int]]:
    """The seconds of a slice that can be sent first, and the second sent last in each case, by pointer doubling."""
    t = np.sort(rows["_s"].to_numpy())
    n = len(t)
    following = np.searchsorted(t, t + window_s, side="right")
    last = np.where(following < n, following, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    # Whatever was sent before the slice was sent before its first second.
    can = min(int(np.searchsorted(t, t[0] - 1 + window_s, side="right")) + 1, n)
    return t[:can].tolist(), t[last[:can]].tolist()


def _entries(rows: DataFrame, keys: list[str], slices: Slices, window_s: int) -> DataFrame:
    """(keys, _slice, _entry): the second sent last before each slice of the hot keys."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = _slice_map(pdf, window_s)
        return pdf[[*keys, "_slice"]].iloc[:1].assign(first=[first], last=[last])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        sent, out = _NEVER, []
        for first, last in zip(pdf["first"], pdf["last"]):
            out.append(sent)
            i = int(np.searchsorted(first, sent + window_s, side="right"))
            sent = int(last[i]) if i < len(last) else sent
        return pdf[[*keys, "_slice"]].assign(_entry=out)

    maps = rows.groupBy(*slices.part).applyInPandas(summary, f"{named}, _slice int, first array<long>, last array<long>")
    # At most GRID slices of a key, each with one entry per second of the window.
    return maps.groupBy(*keys).applyInPandas(chain, f"{named}, _slice int, _entry long")


def suppress_repeats(
    alerts: DataFrame, keys: Sequence[str], *, window_s: int = R.ALERT_WINDOW_S, counts: Column | None = None,
    hot_rows: int | None = None, ts: str = "ts_us", tie: str = "event_id",
) -> DataFrame:
    """Mark each alert ``sent`` or ``deduped``.

    An alert is suppressed when one of its key was sent at most ``window_s``
    before. Alerts for which ``counts`` is false take no part in that. Alerts of one key
    and second collapse to their first. Every second points to the next one that could be sent
    after it; slices of hot keys are first reduced to who is sent last for whoever is
    sent first, so an unbroken run of alerts is many tasks.
    """
    keys = list(keys)
    taking_part = alerts if counts is None else alerts.where(counts)
    seconds = taking_part.withColumn("_s", floor_div(F.col(ts), US))
    slices = find_slices(seconds, keys, "_s", hot_rows)
    per_second = seconds.groupBy(*keys, "_s").agg(F.min(F.struct(ts, tie)).alias("_f")).select(
        *keys, "_s", F.col(f"_f.{ts}").alias("_first_ts"), F.col(f"_f.{tie}").alias("_first_tie")
    )
    rows = slices.cut(per_second, "_s")
    if slices.borders:
        rows = rows.join(_entries(rows.where("_slice > 0"), keys, slices, window_s), [*keys, "_slice"], "left")
        rows = rows.withColumn("_entry", F.coalesce("_entry", F.lit(_NEVER).cast("long")))
    else:
        rows = rows.withColumn("_entry", F.lit(_NEVER).cast("long"))
    names = [*keys, "_first_ts", "_first_tie"]
    part = slices.part

    def sent_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sent_at = None, _NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            seconds_, entry = batch.column("_s").to_numpy(), batch.column("_entry").to_numpy()
            first = np.append(0, np.flatnonzero(_changes(batch, part)))
            begin = entry[first].copy()
            head = batch.slice(0, 1).select(part)
            if before is not None and head.equals(before):
                begin[0] = sent_at  # the run goes on from the batch before
            sent = _send(seconds_, first, begin, window_s)
            tail = np.flatnonzero(sent[first[-1]:])
            sent_at = int(seconds_[first[-1] + tail[-1]]) if len(tail) else int(begin[-1])
            before = batch.slice(batch.num_rows - 1, 1).select(part)
            yield batch.select(names).filter(pa.array(sent))

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)
    ordered = rows.select(*dict.fromkeys([*part, *names]), "_s", "_entry").repartition(*part).sortWithinPartitions(*part, "_s")
    sent_rows = ordered.mapInArrow(sent_only, schema).select(*keys, F.col("_first_ts").alias(ts), F.col("_first_tie").alias(tie), F.lit(True).alias("_sent"))
    out = alerts.join(sent_rows, [*keys, ts, tie], "left")
    return out.withColumn("status", F.when(F.col("_sent"), "sent").otherwise("deduped")).drop("_sent")
