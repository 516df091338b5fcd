"""Attributions: exact for linear models, summed up to drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_attribution(rows: DataFrame, coefficients: dict[str, float], scale: dict[str, tuple[float, float]]) -> DataFrame:
    """``<feature>_attr``: coefficient times the standardised value's distance from its mean.

    They sum to the margin less the mean margin; ``scale`` has each feature's (mean, deviation).
    """
    z = {f: (F.col(f) - scale[f][0]) / scale[f][1] for f in coefficients}
    means = rows.agg(*(F.avg(z[f]).alias(f"{f}_mean") for f in coefficients))
    return rows.join(F.broadcast(means)).select("pid", *((coefficients[f] * (z[f] - F.col(f"{f}_mean"))).alias(f"{f}_attr") for f in coefficients))


def drivers_from_features(attributions: DataFrame, names: DataFrame) -> DataFrame:
    """Sum of attributions and the greatest raw value of each driver's features; ``names (feature, driver)``."""
    return attributions.join(F.broadcast(names), "feature").groupBy("pid", "driver").agg(F.sum("value").alias("value"), F.max("raw").alias("raw"))
