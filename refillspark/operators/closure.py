"""Closing the loop: observed dispenses, outcomes and the labels that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_dispense(events: DataFrame, start: str, end: str) -> DataFrame:
    """The earliest confirmed dispense of each subject in the closed window; orders alone never count."""
    inside = (F.col("is_dispense") == 1) & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return events.where(inside).groupBy("pid").agg(F.min("date").alias("event_date"))


def refill_outcomes(routed: DataFrame, events: DataFrame, covered: DataFrame, start: str, as_of: str, source: str = "claims", latency: int = 30) -> DataFrame:
    """``latency`` is the source's typical one. Covered with a dispense: on time. Covered without: a break as of the day. Not covered: no row."""
    known = routed.select("pid").join(covered.where("covered = 1").select("pid"), "pid", "left_semi")
    rows = known.join(first_dispense(events, start, as_of), "pid", "left")
    return rows.select(
        "pid",
        F.lit(1).alias("observed"),
        F.col("event_date").isNotNull().cast("int").alias("on_time_refill"),
        F.coalesce("event_date", F.to_date(F.lit(as_of))).alias("event_date"),
        F.lit(source).alias("refill_source"),
        F.lit(latency).alias("refill_latency_days"),
    )


def closure_summary(routed: DataFrame, outcomes: DataFrame) -> DataFrame:
    rows = routed.select("pid").join(outcomes, "pid", "left")
    on_time = F.col("on_time_refill")
    return rows.agg(F.count("*").alias("n_routed"), F.count("observed").alias("n_observed"), F.count_if(on_time == 1).alias("n_on_time"), F.count_if(on_time == 0).alias("n_break"))


def harvest_labels(outcomes: DataFrame, actioned: DataFrame | None = None) -> DataFrame:
    """One label for each observed subject, if wished only those that an action reached; provenance stays apart."""
    rows = outcomes.where("observed = 1")
    if actioned is not None:
        rows = rows.join(actioned.select("pid"), "pid", "left_semi")
    return rows.select("pid", F.col("on_time_refill").alias("adherent"), F.struct("refill_source", "refill_latency_days").alias("provenance"))

