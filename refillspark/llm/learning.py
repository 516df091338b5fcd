"""Bounded samples of labelled rows, and fitted models on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sampled_labels(rows: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, learn: Column, most_rows: int) -> DataFrame:
    """``rows (id, text, ...)`` with their ``label``, and a constant column ``all``.

    At most ``most_rows`` labelled ids for which ``learn`` holds, those with the smallest hashes;
    they are broadcast, so that the texts of all other rows stay where they are. Repeated labels of
    an id count once (the largest label), and of its rows the one with the least text (nulls
    first); labels other than 0 and 1 don't count.
    """
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn)
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    given = given.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    least = rows.join(F.broadcast(given), "id").groupBy("id", "label").agg(F.min(F.struct("text", *(c for c in rows.columns if c not in ("id", "text")))).alias("row"))
    return least.select("id", "label", "row.*").withColumn("all", F.lit(0))


def shared(spark: SparkSession, value):
    """A broadcast of a fitted model, whose size doesn't depend on the input's."""
    return spark.sparkContext.broadcast(value)
