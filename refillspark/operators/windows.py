"""Ranking, capacity, splits and deterministic batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distributed import join_with_nulls, running_count


def rank_in_role(cards: DataFrame) -> DataFrame:
    """Within a role those for human review first, then by score (nulls last); the id decides ties. Cards without a role are ranked among themselves."""
    step = F.when(F.col("score") > 0, F.floor(-F.log("score") * 1000)).otherwise(1 << 40)
    review = F.coalesce(F.col("needs_review") == 1, F.lit(False))
    rows = cards.withColumn("bucket_", F.when(review, step - (1 << 42)).otherwise(step))
    return running_count(rows, "bucket_", [F.desc(review), F.desc("score"), "pid"], "rank_in_role", by="role").drop("bucket_").select(*cards.columns, F.col("rank_in_role").cast("int").alias("rank_in_role"))


def apply_caps(ranked: DataFrame, caps: DataFrame) -> DataFrame:
    """``effective_cap`` is the role's cap, or as many as need review; a role without a cap, or with a null one, takes everyone.

    ``expanded`` marks those for review in a role whose cap they raised. Cards without a role are a
    role of their own; every card stays.
    """
    roles = ranked.groupBy("role").agg(F.count("*").cast("int").alias("size_"), F.count_if(F.col("needs_review") == 1).cast("int").alias("reviews_"))
    known = caps.where("role is not null and cap is not null").groupBy("role").agg(F.max("cap").alias("cap_"))
    out = join_with_nulls(ranked, roles.join(F.broadcast(known), "role", "left"), ["role"])
    cap = F.coalesce("cap_", "size_")
    effective = F.greatest(cap, F.col("reviews_"))
    return out.select(
        *ranked.columns,
        effective.alias("effective_cap"),
        F.coalesce((effective > cap) & (F.col("needs_review") == 1), F.lit(False)).cast("int").alias("expanded"),
        (F.col("rank_in_role") <= effective).cast("int").alias("included"),
    )


def temporal_split(panel: DataFrame, train: float = 0.70, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """By index date and id, cut at half-even rounded counts; rows without an index date drop out."""
    if abs(train + validation + test - 1) > 1e-9 or min(train, validation, test) < 0:
        raise ValueError("the fractions must be at least 0 and sum to 1")
    rows = running_count(panel.where("index_date is not null").select("pid", "index_date"), "index_date", ["pid"], "place")
    total = rows.agg(F.count("*").alias("n"))
    rows = rows.join(F.broadcast(total))  # one row
    first, second = F.bround(F.col("n") * train), F.bround(F.col("n") * train) + F.bround(F.col("n") * validation)
    split = F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "validation").otherwise("test")
    return rows.select("pid", "index_date", split.alias("split"))


def temporal_leaks(split: DataFrame) -> DataFrame:
    """A row for each later split that begins before an earlier one ends; none if all is well."""
    ends = split.groupBy("split").agg(F.min("index_date").alias("least"), F.max("index_date").alias("most"))
    a, b = ends.alias("a"), ends.alias("b")
    pairs = F.concat(F.col("a.split"), F.lit("<"), F.col("b.split")).isin("train<validation", "validation<test", "train<test")
    return a.join(b, pairs & (F.col("a.most") > F.col("b.least"))).select(F.col("a.split").alias("earlier"), F.col("b.split").alias("later"))


def stratified_folds(rows: DataFrame, label_col: str = "event", k: int = 5, seed: int = 42) -> DataFrame:
    """Each row in one fold, every class spread evenly, in an order that only the ids and the seed decide; rows without a label are a class of their own."""
    shuffle = F.md5(F.concat_ws("|", F.col("pid").cast("string"), F.lit(str(seed))))
    prefix = F.substring(shuffle, 1, 2)
    placed = running_count(rows.withColumn("prefix", prefix).withColumn("shuffle", shuffle), "prefix", ["shuffle", "pid"], "place", by=label_col)
    return placed.withColumn("fold", ((F.col("place") - 1) % k).cast("int")).drop("prefix", "shuffle", "place")


def rank_drivers(attributions: DataFrame, modifiable: list[str]) -> DataFrame:
    rows = attributions.where((F.col("value") > 0) & F.col("driver").isin(*modifiable))
    return rows.withColumn("driver_rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("value"), "driver")))


def incremental_batches(ids: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """A deterministic order of reveal without repetition, in batches of ``size``."""
    shuffle = F.md5(F.concat_ws("|", F.col("pid").cast("string"), F.lit(str(seed))))
    rows = ids.select("pid").distinct().withColumn("shuffle", shuffle).withColumn("prefix", F.substring(shuffle, 1, 2))
    placed = running_count(rows, "prefix", ["shuffle", "pid"], "place")
    return placed.select("pid", F.floor((F.col("place") - 1) / size).cast("int").alias("batch"))
