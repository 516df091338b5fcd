"""Escalation by event-time timers: a subject's state moves when its own boundary passes, not when a tick comes.

The processor keeps of each subject when it entered, its first dispense and a counter; rounds and
statuses are the column logic of ``operators.escalation`` over what it says.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.escalation import boundary_offsets, escalation_status, round_schedule
from ..storage import new_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NEWS = "pid long, entry_date date, event_date date, as_of date, n long"


def _processor() -> StatefulProcessor:
    class Boundaries(StatefulProcessor):
        """Says ``(pid, entry_date, event_date, as_of, n)`` with every dispense or new row, and on every boundary that passes."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("kept", "entry_date date, event_date date, as_of date, n long")

        def _say(self, key, entry, event, as_of) -> Iterator[Row]:
            n = self.kept.get()[3] + 1 if self.kept.exists() else 0
            self.kept.update((entry, event, as_of, n))
            yield Row(pid=key[0], entry_date=entry, event_date=event, as_of=as_of, n=n)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            seen = [(r.ts.date(), r.is_dispense == 1, r.offsets) for r in rows]
            days, bought = [d for d, _, _ in seen], [d for d, b, _ in seen if b]
            entry, event, as_of, _ = self.kept.get() if self.kept.exists() else (None, None, None, 0)
            if entry is None:
                entry = min(days)
                for offset in seen[0][2]:
                    due = dt.datetime.combine(entry + dt.timedelta(days=offset), dt.time(), dt.timezone.utc)
                    if due.timestamp() * 1000 > timerValues.getCurrentWatermarkInMs():
                        self.handle.registerTimer(int(due.timestamp() * 1000))
            event = min([d for d in (event, *bought) if d is not None], default=None)
            yield from self._say(key, entry, event, max([d for d in (as_of, *days) if d is not None]))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            entry, event, as_of, _ = self.kept.get()
            due = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).date()
            if event is None and due > as_of:  # a closed loop doesn't move again
                yield from self._say(key, entry, event, due)

        def close(self) -> None:
            pass

    return Boundaries()


def escalate_on_time(stream: DataFrame, cards: DataFrame, status: DataFrame, latency: int, delay_days: int, root: str | None = None) -> DataFrame:
    """The states of the subjects of ``stream (pid, ts, is_dispense)`` who have a card, as of the last thing that happened to each.

    Time is the stream's: its watermark lies ``delay_days`` behind the latest row, and a subject's
    timers stand at its boundaries (when a round acts, escalates, and may escalate safely). A
    subject enters on the day of its earliest row in the micro-batch that brings it first, and what
    is due then counts as dispatched. The first dispense closes the loop for good. Rows behind the
    watermark are left out (``latency_counts`` tells how many). With the same ``root`` a stopped
    stream goes on: timers and states lie in the RocksDB store of its checkpoint.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, "timers")
    offsets = boundary_offsets(cards, latency)
    rows = stream.where("pid is not null and ts is not null").withWatermark("ts", f"{delay_days} days").join(offsets, "pid")
    news = rows.groupBy("pid").transformWithState(_processor(), _NEWS, "Append", "EventTime")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        news.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/news").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    said = spark.read.schema(_NEWS).parquet(f"{root}/news")
    last = said.groupBy("pid").agg(F.max_by(F.struct("entry_date", "event_date", "as_of"), "n").alias("s")).select("pid", "s.*")
    scheduled = round_schedule(last.select("pid", "entry_date", "as_of").join(cards.select("pid", "driver", "is_safety", "days_to_break"), "pid"), latency)
    outcomes = last.where("event_date is not null").select("pid", F.lit(1).alias("observed"), F.lit(1).alias("on_time_refill"), "event_date")
    states = escalation_status(scheduled, outcomes, status, F.col("as_of"))
    return states.withColumn("status", F.when(F.col("status") == "PENDING", "DISPATCHED").otherwise(F.col("status")))
