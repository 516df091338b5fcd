"""Cohorts: who has a code, who was treated, when a subject starts, and what lies before that day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import age_years, clip_interval, coverage_end, days_before, elapsed_days
from ..storage import kept

#: Longer code lists are joined as a table (a code list is configuration, far below a broadcast's bound).
_INLINE_CODES = 500


def with_codes(events: DataFrame, codes: Sequence[str], code_col: str = "code") -> DataFrame:
    if len(codes) <= _INLINE_CODES:
        return events.where(F.col(code_col).isin(*codes))
    listed = events.sparkSession.createDataFrame([(c,) for c in codes], f"{code_col} string")
    return events.join(F.broadcast(listed), code_col, "left_semi")


def subjects_with_code(events: DataFrame, codes: Sequence[str]) -> DataFrame:
    return with_codes(events, codes).select("pid").distinct()


def cohort_intersection(diagnosed: DataFrame, treated: DataFrame) -> DataFrame:
    return diagnosed.select("pid").intersect(treated.select("pid"))


def attach_demographics(ids: DataFrame, subjects: DataFrame, ref_date: str) -> DataFrame:
    ref = F.to_date(F.lit(ref_date))
    found = subjects.join(ids.select("pid"), "pid")
    return found.withColumn("age", age_years(F.col("birth"), F.col("death"), ref)).withColumn("deceased", F.col("death").isNotNull().cast("int"))


def cohort_flow(**steps: DataFrame) -> DataFrame:
    """``(step, n)``: distinct subjects of each step."""
    out = None
    for name, frame in steps.items():
        row = frame.agg(F.countDistinct("pid").alias("n")).select(F.lit(name).alias("step"), "n")
        out = row if out is None else out.union(row)
    return out


def incident_index_date(fills: DataFrame, codes: Sequence[str], washout: int = 365) -> DataFrame:
    """The earliest fill without another one in the days before it."""
    before = F.lag("start").over(Window.partitionBy("pid").orderBy("start"))
    gaps = with_codes(fills, codes).where("start is not null").withColumn("gap", elapsed_days(before, F.col("start")))
    return gaps.where(F.col("gap").isNull() | (F.col("gap") > washout)).groupBy("pid").agg(F.min("start").alias("index_date"))


def pre_index_rows(events: DataFrame, cohort: DataFrame, date_col: str, lookback: int | None = None) -> DataFrame:
    """Rows strictly before the index date (and within ``lookback`` days of it): the leakage rule.

    Null dates and null index dates drop out. Adds ``index_date``.
    """
    joined = events.join(cohort.select("pid", "index_date"), "pid").where(F.col(date_col) < F.col("index_date"))
    return joined if lookback is None else joined.where(F.col(date_col) >= days_before("index_date", lookback))


def baseline_eligible(cohort: DataFrame, observations: DataFrame, code: str, lookback: int = 1095) -> DataFrame:
    """Subjects with a coded reading in ``[index - lookback, index)``."""
    o = observations.where(F.col("code") == code).select(F.col("pid").alias("o_pid"), "date")
    inside = (F.col("pid") == F.col("o_pid")) & (F.col("date") < F.col("index_date")) & (F.col("date") >= days_before("index_date", lookback))
    return cohort.join(o, inside, "left_semi")


def split_included_excluded(subjects: DataFrame, indexed: DataFrame, eligible: DataFrame) -> DataFrame:
    """``(pid, index_date, included, reason)``: the complement is kept, with its reason."""
    out = subjects.select("pid").join(indexed, "pid", "left").join(eligible.select("pid", F.lit(1).alias("ok")).distinct(), "pid", "left")
    reason = F.when(F.col("index_date").isNull(), "no_fill").when(F.col("ok").isNull(), "no_baseline_obs")
    return out.select("pid", "index_date", reason.isNull().cast("int").alias("included"), reason.alias("reason"))


def forward_window_intervals(fills: DataFrame, cohort: DataFrame, days: int = 180) -> DataFrame:
    """Coverage clipped to ``[index, index + days)``: ``(pid, ws, we, cs, ce)``, empty ones dropped."""
    joined = fills.join(cohort.select("pid", "index_date"), "pid").where("start is not null and index_date is not null")
    ws, we = F.col("index_date"), F.date_add("index_date", days)
    cs, ce = clip_interval(F.col("start"), coverage_end(F.col("start"), F.col("stop")), ws, we)
    return joined.select("pid", ws.alias("ws"), we.alias("we"), cs.alias("cs"), ce.alias("ce")).where("cs < ce")


def latest_value(readings: DataFrame) -> DataFrame:
    """The reading closest to the index; the smallest value on ties."""
    latest = F.max_by("value", F.struct(F.col("date"), -F.col("value")))
    return readings.where("value is not null").groupBy("pid", "code").agg(latest.alias("latest"))


def assemble_panel(cohort: DataFrame, features: Sequence[DataFrame], defaults: dict[str, float]) -> DataFrame:
    """Left joins on ``pid``; counts default to 0, undefined quantities stay null."""
    for frame in features:
        cohort = cohort.join(frame, "pid", "left")
    return cohort.fillna({k: v for k, v in defaults.items() if k in cohort.columns})


def labelled_frame(panel: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    return panel.join(labels, "pid").dropna(subset=[label_col])


FEATURE_PREFIXES = ("sbp_", "dbp_", "flag_", "cmb_", "rx_", "engage_", "payer_", "xdrug_", "adh_")
OUTCOMES = ("pdc_180d", "has_30_day_gap", "max_gap")


def select_feature_columns(panel: DataFrame, prefixes: Sequence[str] = FEATURE_PREFIXES, never: Sequence[str] = OUTCOMES) -> DataFrame:
    """Only allowlisted prefixes; an outcome can't pass whatever its prefix."""
    return panel.select("pid", *(c for c in panel.columns if c.startswith(tuple(prefixes)) and c not in never))


def covered_subjects(ids: DataFrame, feed: DataFrame) -> DataFrame:
    """``(pid, covered)``: whether the feed knows the subject at all."""
    known = feed.select("pid", F.lit(1).alias("covered")).distinct()
    return ids.select("pid").join(known, "pid", "left").fillna({"covered": 0})


def overlay_labels(labels: DataFrame, observed: DataFrame) -> DataFrame:
    """An observed outcome replaces the label; others stay."""
    seen = observed.select("pid", (1 - F.col("adherent")).alias("seen"))
    return labels.join(seen, "pid", "left").select("pid", F.coalesce("seen", "has_30_day_gap").cast("int").alias("has_30_day_gap"))


def group_profile(included: DataFrame, excluded: DataFrame, subjects: DataFrame, conditions: DataFrame, ref_date: str) -> DataFrame:
    """Both sides' size, mean age, distinct conditions and years since the first one: selection bias."""
    ref = F.to_date(F.lit(ref_date))
    sides = included.select("pid", F.lit("included").alias("side")).union(excluded.select("pid", F.lit("excluded").alias("side")))
    known = kept(conditions.groupBy("pid").agg(F.countDistinct("code").alias("n_conditions"), F.min("start").alias("first_dx")), "known")
    rows = sides.join(subjects.select("pid", "birth", "death"), "pid").join(known, "pid", "left")
    return rows.groupBy("side").agg(
        F.count("*").alias("n"),
        F.round(F.avg(age_years(F.col("birth"), F.col("death"), ref)), 6).alias("mean_age"),
        F.round(F.avg(F.coalesce("n_conditions", F.lit(0))), 6).alias("mean_conditions"),
        F.round(F.avg(F.datediff(ref, "first_dx") / 365.25), 6).alias("mean_years_since_dx"),
    )
