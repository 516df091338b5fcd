"""Features strictly before the index date: one aggregate pass over each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import days_before, elapsed_days, fractional_days
from ..storage import kept
from .cohort import pre_index_rows


def _six(c: Column) -> Column:
    return F.round(c, 6)


def ols_slope(value: Column, days: Column) -> Column:
    """Slope per day; null for fewer than two rows or no spread in time."""
    return F.regr_slope(value, days)


def trajectory(observations: DataFrame, cohort: DataFrame, channels: dict[str, str], lookback: int | None = 1095) -> DataFrame:
    """For each channel (name: code) mean, max, min, latest reading and slope, in one pass."""
    rows = pre_index_rows(observations, cohort, "date", lookback).where("value is not null")
    rows = rows.where(F.col("code").isin(*channels.values())).withColumn("days", fractional_days(F.col("index_date"), F.col("date")))
    aggregates = []
    for name, code in channels.items():
        own = F.col("code") == code
        value = F.when(own, F.col("value"))
        aggregates += [
            _six(F.avg(value)).alias(f"{name}_mean"),
            F.max(value).alias(f"{name}_max"),
            F.min(value).alias(f"{name}_min"),
            F.max_by("value", F.when(own, F.struct(F.col("date"), -F.col("value")))).alias(f"{name}_latest_reading"),
            _six(ols_slope(value, F.when(own, F.col("days").cast("double")))).alias(f"{name}_trajectory_slope"),
        ]
    return cohort.select("pid").join(rows.groupBy("pid").agg(*aggregates), "pid", "left")


def lab_trajectory(observations: DataFrame, cohort: DataFrame, labs: dict[str, str]) -> DataFrame:
    """Latest value and slope of each lab over all history before the index."""
    found = trajectory(observations, cohort, {f"lab_{k}": v for k, v in labs.items()}, None)
    return found.select("pid", *(F.col(f"lab_{k}_{long}").alias(f"lab_{k}_{short}") for k in labs for long, short in (("latest_reading", "latest"), ("trajectory_slope", "slope"))))


def comorbidity_count(conditions: DataFrame, cohort: DataFrame) -> DataFrame:
    found = pre_index_rows(conditions, cohort, "start").groupBy("pid").agg(F.countDistinct("code").alias("cmb_n_conditions"))
    return cohort.select("pid").join(found, "pid", "left").fillna({"cmb_n_conditions": 0})


def regimen_counts(fills: DataFrame, cohort: DataFrame) -> DataFrame:
    rows = pre_index_rows(fills, cohort, "start")
    active = F.col("stop").isNull() | (F.col("stop") > F.col("index_date"))
    recent = F.col("start") >= days_before("index_date", 365)
    found = rows.groupBy("pid").agg(F.countDistinct(F.when(active, F.col("code"))).alias("rx_n_active_meds"), F.countDistinct(F.when(recent, F.col("code"))).alias("rx_n_meds_started_1y"))
    return cohort.select("pid").join(found, "pid", "left").fillna(0, ["rx_n_active_meds", "rx_n_meds_started_1y"])


def engagement_counts(encounters: DataFrame, readings: DataFrame, cohort: DataFrame) -> DataFrame:
    """Visits in a year and readings in three; both are stored, so that no task sorts the rows of the two sources."""
    visits = kept(pre_index_rows(encounters, cohort, "start", 365).groupBy("pid").agg(F.count("*").alias("engage_n_encounters")), "visits")
    taken = kept(pre_index_rows(readings, cohort, "date", 1095).groupBy("pid").agg(F.count("*").alias("engage_n_bp_readings")), "readings")
    return cohort.select("pid").join(visits, "pid", "left").join(taken, "pid", "left").fillna(0, ["engage_n_encounters", "engage_n_bp_readings"])


def acute_utilization(encounters: DataFrame, cohort: DataFrame, classes: dict[str, str] = {"ed": "emergency", "inpatient": "inpatient", "urgentcare": "urgentcare"}) -> DataFrame:
    """Visits by class in a year, and days since the last acute one over all history (null without one)."""
    rows = pre_index_rows(encounters, cohort, "start").where(F.col("class").isin(*classes.values()))
    recent = F.col("start") >= days_before("index_date", 365)
    counts = [F.count_if(recent & (F.col("class") == c)).alias(f"acute_n_{n}_1y") for n, c in classes.items()]
    found = rows.groupBy("pid").agg(*counts, F.min(elapsed_days(F.col("start"), F.col("index_date"))).alias("acute_days_since_last"))
    return cohort.select("pid").join(found, "pid", "left").fillna(0, [f"acute_n_{n}_1y" for n in classes])


def payer_switches(payers: DataFrame, cohort: DataFrame) -> DataFrame:
    """Consecutive periods with different payers; a missing one before is no switch."""
    before = F.lag("payer").over(Window.partitionBy("pid").orderBy("start", "tie"))
    rows = pre_index_rows(payers, cohort, "start").withColumn("switch", F.coalesce((before != F.col("payer")).cast("int"), F.lit(0)))
    found = rows.groupBy("pid").agg(F.sum("switch").alias("payer_n_switches"))
    return cohort.select("pid").join(found, "pid", "left").fillna({"payer_n_switches": 0})


def cross_drug_profile(fills: DataFrame, cohort: DataFrame, index_codes: Sequence[str]) -> DataFrame:
    """Fills outside the index class: breadth, tenure, recency, encounters, mean out-of-pocket cost."""
    rows = pre_index_rows(fills.where(~F.col("code").isin(*index_codes)), cohort, "start")
    found = rows.groupBy("pid").agg(
        F.countDistinct("code").alias("xdrug_n_distinct_meds"),
        F.max(elapsed_days(F.col("start"), F.col("index_date"))).alias("xdrug_tenure_days"),
        F.min(elapsed_days(F.col("start"), F.col("index_date"))).alias("xdrug_days_since_last_fill"),
        F.countDistinct("encounter").alias("xdrug_n_prescribers"),
        _six(F.avg(F.col("total") - F.col("covered"))).alias("xdrug_oop_cost_mean"),
    )
    return cohort.select("pid").join(found, "pid", "left").fillna(0, ["xdrug_n_distinct_meds", "xdrug_tenure_days", "xdrug_n_prescribers"])


def refill_gaps(fills: DataFrame, cohort: DataFrame, index_codes: Sequence[str]) -> DataFrame:
    """Gaps between fills of one drug, pooled by subject; cv is null for fewer than two gaps or a zero mean."""
    rows = pre_index_rows(fills.where(~F.col("code").isin(*index_codes)), cohort, "start")
    gaps = rows.withColumn("gap", elapsed_days(F.lag("start").over(Window.partitionBy("pid", "code").orderBy("start")), F.col("start")))
    found = gaps.where("gap is not null").groupBy("pid").agg(
        _six(F.avg("gap")).alias("xdrug_refill_gap_mean"),
        F.max("gap").alias("xdrug_refill_gap_max"),
        _six(F.stddev_samp("gap") / F.nullif(F.avg("gap"), F.lit(0.0))).alias("xdrug_refill_gap_cv"),
    )
    return cohort.select("pid").join(found, "pid", "left")


def barrier_flags(events: DataFrame, cohort: DataFrame, groups: DataFrame, names: Sequence[str]) -> DataFrame:
    """``flag_<group>``: any row of the group's codes before the index; always 0 or 1.

    ``groups (code_group, code)`` is the code dictionary, a small configuration table.
    """
    rows = pre_index_rows(events, cohort, "start").join(F.broadcast(groups), "code")
    found = rows.groupBy("pid").agg(*(F.max(F.when(F.col("code_group") == n, 1).otherwise(0)).alias(f"flag_{n}") for n in names))
    return cohort.select("pid").join(found, "pid", "left").fillna(0)


def strict_flag(events: DataFrame, cohort: DataFrame, codes: Sequence[str], name: str, least_dates: int = 2, recency: int = 365) -> DataFrame:
    """Recurring and recent: enough distinct days, the last of them within ``recency``."""
    rows = pre_index_rows(events.where(F.col("code").isin(*codes)), cohort, "start")
    found = rows.groupBy("pid", "index_date").agg(F.countDistinct("start").alias("n"), F.max("start").alias("last"))
    holds = (F.col("n") >= least_dates) & (F.col("last") >= days_before("index_date", recency))
    return cohort.select("pid").join(found.select("pid", holds.cast("int").alias(f"flag_{name}")), "pid", "left").fillna(0)


def any_flag(flags: DataFrame, name: str = "flag_sdoh_any") -> DataFrame:
    columns = [c for c in flags.columns if c.startswith("flag_")]
    return flags.withColumn(name, F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))


def survival_labels(labels: DataFrame, days: int = 180) -> DataFrame:
    """``(pid, event, time)``: censored subjects have the whole window, others the covered part, 1 at least."""
    known = labels.where("pdc_180d is not null and has_30_day_gap is not null")
    held = F.least(F.greatest(F.col("pdc_180d"), F.lit(0.0)), F.lit(1.0)) * days
    return known.select("pid", F.col("has_30_day_gap").alias("event"), F.when(F.col("has_30_day_gap") == 0, F.lit(float(days))).otherwise(F.greatest(held, F.lit(1.0))).alias("time"))
