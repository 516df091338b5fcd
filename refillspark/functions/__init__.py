"""Column functions: tolerant parsing, dates, intervals, text and deterministic buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ts(c: Column) -> Column:
    """ISO text to a UTC timestamp; what can't be parsed is null."""
    return c.try_cast("timestamp")


def parse_day(c: Column) -> Column:
    return c.try_cast("timestamp").cast("date")


def to_number(c: Column) -> Column:
    """Tolerant number; what can't be parsed, and NaN, is null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def elapsed_days(a: Column, b: Column) -> Column:
    """Whole 24-hour days from ``a`` to ``b``, rounded down also where negative."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def age_years(birth: Column, death: Column, ref: Column) -> Column:
    return F.floor(F.datediff(F.coalesce(death, ref), birth) / 365.25).cast("int")


def coverage_end(start: Column, stop: Column, default_days: int = 30) -> Column:
    """The stop if it lies after the start, else a default supply."""
    return F.when(stop > start, stop).otherwise(F.date_add(start, default_days))


def clip_interval(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return F.greatest(start, low), F.least(end, high)


def scaled_between(c: Column, least: Column, most: Column, low: float = 0.1, high: float = 1.0) -> Column:
    """Scaled between given ends; where they are equal ``high``."""
    return F.when(most > least, low + (c - least) / (most - least) * (high - low)).when(c.isNotNull(), F.lit(high))


def min_max_scale(rows: DataFrame, value: Column, by: str, name: str) -> DataFrame:
    """Adds ``value`` scaled within its group (a null one is a group too); the ends come from an aggregate that combines before the shuffle."""
    ends = rows.groupBy(F.col(by).alias("by_")).agg(F.min(value).alias("least_"), F.max(value).alias("most_"))
    met = rows.join(ends, F.col(by).eqNullSafe(F.col("by_")), "left")
    return met.withColumn(name, scaled_between(value, F.col("least_"), F.col("most_"))).drop("by_", "least_", "most_")


def fractional_days(a: Column, b: Column) -> Column:
    """24-hour days from ``a`` to ``b``, with their fraction."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000)


def days_before(c: Column | str, days: int) -> Column:
    """So many days earlier: a date stays a date, and a timestamp keeps its time of day."""
    return (F.col(c) if isinstance(c, str) else c) - F.expr(f"INTERVAL '{int(days)}' DAY")


def hash_bucket(c: Column, buckets: int = 100) -> Column:
    """SHA-1 as one big number modulo ``buckets``."""
    digest = F.sha1(c.cast("string").cast("binary"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1
    digits = F.transform(F.sequence(F.lit(1), F.lit(40)), digit)
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % buckets)


def render_template(template: Column, fields: dict[str, Column]) -> Column:
    """``{name}`` replaced by each field's text; a missing value is an empty text."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def deid_ref(c: Column) -> Column:
    return F.concat(F.lit("Patient #"), F.substring(c.cast("string"), 1, 8))


def display_window(as_of: Column, days: Column, slack: int = 3) -> tuple[Column, Column]:
    start = F.date_add(as_of, F.floor(F.greatest(days - slack, F.lit(0))).cast("int"))
    return start, F.date_add(as_of, F.floor(days + slack).cast("int"))
