"""Cases: service levels, listing, current state and timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import strip
from .folds import case_transitions
from .windows import US


def sla_hours(severity: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in R.SLA_HOURS.items() for x in kv]), severity)


def create_cases(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid case requests with their due time, and the rejected ones with a reason."""
    hours = sla_hours(F.col("severity"))
    reason = F.when(strip(F.coalesce("title", F.lit(""))) == "", "title is required").when(hours.isNull(), "invalid severity")
    checked = requests.withColumn("reason", reason)
    good = (
        checked.where("reason IS NULL").drop("reason")
        .withColumn("title", strip("title"))
        .withColumn("status", F.lit("open"))
        .withColumn("sla_due_us", F.col("created_us") + hours.cast("long") * 3600 * US)
    )
    return good, checked.where("reason IS NOT NULL")


def case_list(cases: DataFrame, status: str | None = None, severity: str | None = None) -> DataFrame:
    if status is not None:
        cases = cases.where(F.col("status") == status)
    if severity is not None:
        cases = cases.where(F.col("severity") == severity)
    return cases.orderBy(F.desc("case_id"))


def case_current(cases: DataFrame, steps: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """Current state, last update and allowed next states.

    Legal steps, and ``touches`` (``case_id, ts_us`` of notes and assignments), move ``updated_us``.
    """
    legal = case_transitions(steps).where("legal")
    last = legal.groupBy("case_id").agg(F.max_by("status", "step").alias("_status"), F.max("ts_us").alias("_moved"))
    out = cases.join(last, "case_id", "left").withColumn("status", F.coalesce("_status", F.lit("open")))
    updated = [F.col("created_us"), F.col("_moved")]
    if touches is not None:
        out = out.join(touches.groupBy("case_id").agg(F.max("ts_us").alias("_touched")), "case_id", "left")
        updated.append(F.col("_touched"))
    following: dict[str, list[str]] = {}
    for a, b in R.CASE_TRANSITIONS:
        following.setdefault(a, []).append(b)
    table = F.create_map(*[x for a, b in following.items() for x in (F.lit(a), F.array(*[F.lit(t) for t in b]))])
    return (
        out.withColumn("updated_us", F.greatest(*updated))
        .withColumn("next_states", F.try_element_at(table, F.col("status")))
        .drop("_status", "_moved", "_touched")
    )


def sla_status(cases: DataFrame, as_of_us: Column | int) -> DataFrame:
    """closed / breached / warning (under a quarter left) / ok, and the time left as text."""
    now = as_of_us if isinstance(as_of_us, Column) else F.lit(as_of_us)
    left = F.col("sla_due_us") - now
    total = F.col("sla_due_us") - F.col("created_us")
    state = (
        F.when(F.col("status") == "closed", "closed")
        .when(F.col("sla_due_us").isNull() | F.col("created_us").isNull(), "ok")
        .when(left <= 0, "breached")
        .when((total > 0) & (left / total < 0.25), "warning")
        .otherwise("ok")
    )
    seconds = F.floor(F.abs(left) / F.lit(US)).cast("long")
    text = F.format_string("%s%dh %dm", F.when(left < 0, "-").otherwise(""), F.expr("0L") + F.floor(seconds / 3600),
                           F.floor(F.pmod(seconds, F.lit(3600)) / 60))
    return cases.withColumn("sla_state", state).withColumn("sla_remaining", F.when(left.isNull(), "n/a").otherwise(text))


def case_timeline(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Opening and notes of every case, oldest first; system notes are status changes."""
    opened = cases.select(
        "case_id", F.col("created_us").alias("ts_us"), F.lit("created").alias("kind"),
        F.format_string("Case #%d opened: %s", "case_id", "title").alias("summary"), F.lit(None).cast("string").alias("author"),
    )
    written = notes.select(
        "case_id", F.col("note_us").alias("ts_us"),
        F.when(F.col("author") == "system", "status_change").otherwise("note").alias("kind"), F.col("note").alias("summary"), "author",
    )
    return opened.unionByName(written).orderBy("case_id", "ts_us", F.col("kind") != "created")
