"""Structured Streaming: reveal, score and route, escalate, and hold back for latency.

Streams run to the end of what is there (``availableNow``); their state, checkpoints and results
lie in the folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, new_path, shared_dir  # noqa: F401


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into Parquet and read that."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Versions:
    """A table in numbered versions, one a micro-batch. A version counts once its mark is there, which is written last.

    A stream that is stopped at any point and started again on the same ``root`` writes the
    batch that was under way once more, over what it left, and goes on from the newest complete one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def complete(self) -> list[int]:
        try:
            return sorted(r.version for r in self.spark.read.schema("done boolean, version int").parquet(f"{self.root}/complete").select("version").collect())  # a row a batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def newest(self) -> int | None:
        return max(self.complete(), default=None)

    def before(self, number: int) -> int | None:
        return max((v for v in self.complete() if v < number), default=None)

    def read(self, number: int, what: str = "versions") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{what}/{number}")

    def put(self, df: DataFrame, number: int, what: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{what}/{number}")
        return self.read(number, what)

    def write(self, df: DataFrame, number: int) -> None:
        self.put(df, number, "versions")
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/complete/version={number}")

    def run(self, stream: DataFrame, step: Callable[[DataFrame, int], None]) -> None:
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def reveal(stream: DataFrame, root: str | None = None) -> DataFrame:
    """``(pid, ts, batch)``: each subject once, with the earliest of its rows in the micro-batch in which it first appears.

    Who came before is looked up in the accumulated set in the shared folder, so the stream itself
    keeps no state, and a row that comes late still reveals its subject. Null subjects reveal no one.
    """
    spark = stream.sparkSession
    versions = Versions(spark, root or new_path(spark, "revealed"))
    shape = spark.createDataFrame([], stream.select("pid", "ts").schema).withColumn("batch", F.lit(0))

    def so_far(below: int | None = None) -> DataFrame:
        paths = [f"{versions.root}/versions/{v}" for v in versions.complete() if below is None or v < below]
        return spark.read.schema(shape.schema).parquet(*paths) if paths else shape

    def step(batch: DataFrame, number: int) -> None:
        new = batch.where("pid is not null").groupBy("pid").agg(F.min("ts").alias("ts"))
        versions.write(new.join(so_far(number).select("pid"), "pid", "left_anti").withColumn("batch", F.lit(number)), number)

    versions.run(stream, step)
    return so_far()


def seen_so_far(versions: Versions, batch: DataFrame, number: int) -> DataFrame:
    """``(pid, event_date)``: all subjects up to this batch, and the day of the first dispense of each so far (null: none yet)."""
    day = F.when(F.col("is_dispense") == 1, F.to_date("ts"))
    new, prior = batch.where("pid is not null").select("pid", day.alias("event_date")), versions.before(number)
    known = new if prior is None else versions.read(prior, "seen").union(new)
    return versions.put(known.groupBy("pid").agg(F.min("event_date").alias("event_date")), number, "seen")


def score_and_route(stream: DataFrame, route: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """At each trigger ``route(known)`` scores and ranks all subjects (``pid``) revealed so far anew; the last snapshot is returned.

    With the same ``root`` a stopped stream goes on (see ``Versions``); all snapshots stay there. A
    stream without rows gives the snapshot of no subjects.
    """
    spark = stream.sparkSession
    versions = Versions(spark, root or new_path(spark, "routed"))

    def step(batch: DataFrame, number: int) -> None:
        versions.write(route(seen_so_far(versions, batch, number).select("pid")), number)

    versions.run(stream, step)
    newest = versions.newest()
    return versions.read(newest) if newest is not None else route(spark.createDataFrame([], stream.select("pid").schema))


def escalate(stream: DataFrame, advance: Callable[[DataFrame, DataFrame, DataFrame | None, int], DataFrame], root: str | None = None) -> DataFrame:
    """At each trigger the state of the subjects revealed so far moves on by one tick.

    ``advance(known, outcomes, prior, number)`` gets all subjects seen so far (``pid``), the first
    dispense of each that has had one (``pid, event_date``), both of all batches up to this one so
    that a closed loop stays closed, the state before this tick (None at first) and the batch id.
    With the same ``root`` a stopped stream goes on (see ``Versions``). A stream without rows gives
    the state of no subjects.
    """
    spark = stream.sparkSession
    versions = Versions(spark, root or new_path(spark, "escalation"))

    def step(batch: DataFrame, number: int) -> None:
        seen, prior = seen_so_far(versions, batch, number), versions.before(number)
        state = None if prior is None else versions.read(prior)
        versions.write(advance(seen.select("pid"), seen.where("event_date is not null"), state, number), number)

    versions.run(stream, step)
    newest = versions.newest()
    if newest is not None:
        return versions.read(newest)
    none = spark.createDataFrame([], stream.select("pid").schema)
    return advance(none, none.withColumn("event_date", F.lit(None).cast("date")), None, 0)


def latency_guard(stream: DataFrame, max_latency_days: int) -> DataFrame:
    """Dispenses by day, said only once the source could have shown all of them; rows that come later than that are left out."""
    held = stream.withWatermark("ts", f"{max_latency_days} days")
    counts = held.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("is_dispense").alias("n_dispensed"))
    return counts.select(F.col("window.start").alias("day"), "n", "n_dispensed")


def latency_counts(stream: DataFrame, max_latency_days: int, root: str | None = None) -> DataFrame:
    """``(day, n, n_dispensed, n_late, final)``: all rows by day; ``n_late`` of them came when their day was already closed.

    A day is closed once rows have been seen, in an earlier micro-batch, that are more than
    ``max_latency_days`` after its end; ``final`` is 1 for days that are closed now. So n - n_late
    is what ``latency_guard`` counts, and no row is lost from sight. Rows without a time don't count.
    """
    spark = stream.sparkSession
    versions = Versions(spark, root or new_path(spark, "latency"))
    closed_by = F.expr(f"timestampadd(DAY, {max_latency_days + 1}, day)")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.where("ts is not null").withColumn("day", F.date_trunc("day", "ts"))
        prior = versions.before(number)
        if prior is None:
            rows = rows.withColumn("latest", F.lit(None).cast("timestamp"))
        else:
            rows = rows.join(F.broadcast(versions.read(prior).agg(F.max("latest").alias("latest"))))  # one row
        late = F.coalesce(closed_by <= F.col("latest"), F.lit(False)).cast("int")
        new = rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("is_dispense").cast("long").alias("n_dispensed"), F.sum(late).alias("n_late"), F.max("ts").alias("latest"))
        if prior is not None:
            both = versions.read(prior).union(new).groupBy("day")
            new = both.agg(*(F.sum(c).alias(c) for c in ("n", "n_dispensed", "n_late")), F.max("latest").alias("latest"))
        versions.write(new, number)

    versions.run(stream, step)
    newest = versions.newest()
    days = versions.read(newest) if newest is not None else spark.createDataFrame([], "day timestamp, n long, n_dispensed long, n_late long, latest timestamp")
    final = F.coalesce(closed_by <= F.col("most"), F.lit(False)).cast("int")
    return days.join(F.broadcast(days.agg(F.max("latest").alias("most")))).select("day", "n", "n_dispensed", "n_late", final.alias("final"))  # one row
