"""Coverage: union of intervals by a running maximum, without iterating over a subject's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import coverage_end, days_before, elapsed_days
from .cohort import pre_index_rows


def _before() -> WindowSpec:
    """A subject's intervals before the present one."""
    return Window.partitionBy("pid").orderBy("cs", "ce").rowsBetween(Window.unboundedPreceding, -1)


def sweep(intervals: DataFrame, cohort: DataFrame, days: int = 180) -> DataFrame:
    """``(pid, covered_days, max_gap)`` of every subject of the cohort.

    Overlaps count once; the leading and the trailing stretch are gaps as well. Without intervals
    all of the window is a gap; without an index date both are null.
    """
    reach = F.coalesce(F.max("ce").over(_before()), F.col("ws"))
    steps = intervals.withColumn("reach", reach)
    steps = steps.select(
        "pid", "we", "ce",
        F.greatest(F.datediff("cs", "reach"), F.lit(0)).alias("gap"),
        F.greatest(F.datediff("ce", F.greatest("cs", "reach")), F.lit(0)).alias("net"),
    )
    swept = steps.groupBy("pid").agg(F.sum("net").alias("covered"), F.greatest(F.max("gap"), F.min(F.datediff("we", "ce"))).alias("gap"))
    known = F.col("index_date").isNotNull()
    return cohort.join(swept, "pid", "left").select(
        "pid", F.when(known, F.coalesce("covered", F.lit(0))).cast("long").alias("covered_days"), F.when(known, F.coalesce("gap", F.lit(days))).cast("int").alias("max_gap")
    )


def pdc(swept: DataFrame, days: int = 180) -> DataFrame:
    return swept.select("pid", F.round(F.least(F.col("covered_days") / days, F.lit(1.0)), 6).alias("pdc_180d"))


def gap_flag(swept: DataFrame, threshold: int = 30) -> DataFrame:
    return swept.select("pid", "max_gap", (F.col("max_gap") >= threshold).cast("int").alias("has_30_day_gap"))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Blocks ``(pid, cs, ce)`` of overlapping or touching intervals."""
    opens = F.coalesce((F.col("cs") > F.max("ce").over(_before())).cast("int"), F.lit(1))
    rows = intervals.withColumn("opens", opens)
    rows = rows.withColumn("block", F.sum("opens").over(Window.partitionBy("pid").orderBy("cs", "ce").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("pid", "block").agg(F.min("cs").alias("cs"), F.max("ce").alias("ce")).drop("block")


def prior_coverage(fills: DataFrame, cohort: DataFrame, lookback: int = 365) -> DataFrame:
    """Coverage before the index by any drug, and the fills whose supply reaches into the window.

    Days are whole days of each merged block.
    """
    reaching = pre_index_rows(fills, cohort, "start").withColumn("end", coverage_end(F.col("start"), F.col("stop")))
    low = days_before("index_date", lookback)
    clipped = reaching.select("pid", F.greatest("start", low).alias("cs"), F.least("end", "index_date").alias("ce")).where("cs < ce")
    days = merge_intervals(clipped).groupBy("pid").agg(F.sum(elapsed_days(F.col("cs"), F.col("ce"))).alias("days"))
    counted = clipped.groupBy("pid").agg(F.count("*").alias("n"))
    out = cohort.select("pid").join(days, "pid", "left").join(counted, "pid", "left")
    return out.select(
        "pid", F.round(F.least(F.coalesce("days", F.lit(0)) / lookback, F.lit(1.0)), 6).alias("adh_prior_med_pdc"), F.coalesce("n", F.lit(0)).alias("adh_prior_n_med_fills")
    )
