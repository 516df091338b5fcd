"""The escalation by event-time timers against the same column logic over all rows at once."""

import datetime as dt
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from refillspark.operators import cohort as C  # noqa: E402
from refillspark.operators import escalation as X  # noqa: E402
from refillspark.streaming.timers import escalate_on_time  # noqa: E402

SHAPE = "pid long, ts timestamp, is_dispense int"
DELAY, LATENCY = 2, 5


def at(n, hour=9):
    return dt.datetime(2024, 3, 1, hour) + dt.timedelta(days=n)


TICKS = [
    [(1, at(0), 0), (2, at(1), 0), (3, at(2), 0), (3, at(0), 0), (99, at(2), 1), (None, at(1), 1)],
    [(1, at(25), 1), (4, at(26), 0)],
    [(4, at(50), 0), (1, at(51), 0), (5, at(52), 1)],
    [(3, at(75), 1), (6, at(80), 0)],
    [(6, at(200), 0)],
]


def plain(spark, cards, status, ticks):
    """States of all rows so far: entered with the first tick that has the subject, as of the watermark or its own last row."""
    rows = [(p, t.date(), d, i) for i, tick in enumerate(ticks) for p, t, d in tick if p in range(1, 7)]
    water = max(t for tick in ticks for p, t, _ in tick if p is not None) - dt.timedelta(days=DELAY)
    last, seen = [], {}
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        first = min(r[3] for r in own)
        seen[p] = (p, min(r[1] for r in own if r[3] == first), max(water.date(), *(r[1] for r in own)))
        bought = [r[1] for r in own if r[2] == 1]
        last += [(p, 1, 1, min(bought))] if bought else []
    entered = spark.createDataFrame(list(seen.values()), "pid long, entry_date date, as_of date").join(cards, "pid")
    outcomes = spark.createDataFrame(last, "pid long, observed int, on_time_refill int, event_date date")
    states = X.escalation_status(X.round_schedule(entered, LATENCY), outcomes, status, F.col("as_of"))
    return {r.pid: (r.entry_date, r.round, "DISPATCHED" if r.status == "PENDING" else r.status, r.closed_on_round) for r in states.collect()}


def test_timers_give_the_states_of_a_batch_also_after_stops(spark, tmp_path):
    cards = spark.createDataFrame([(p, "cost", int(p == 2), float(d)) for p, d in ((1, 90), (2, 70), (3, 65), (4, 20), (5, 40), (6, 55))], "pid long, driver string, is_safety int, days_to_break double")
    status = spark.createDataFrame([(p, "granted", "granted", 0, int(p != 4), 1) for p in range(1, 7)], "pid long, internal string, external string, stale int, internal_allowed int, external_allowed int")
    path, root = f"file://{tmp_path}/in", f"file://{tmp_path}/root"
    statuses = set()
    for stop in (1, 3, 5):  # every run but the first goes on from what the one before it left
        for tick in TICKS[{1: 0, 3: 1, 5: 3}[stop] : stop]:
            spark.createDataFrame(tick, SHAPE).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)
        got = {r.pid: (r.entry_date, r.round, r.status, r.closed_on_round) for r in escalate_on_time(stream, cards, status, LATENCY, DELAY, root).collect()}
        assert got == plain(spark, cards, status, TICKS[:stop])
        statuses |= {s for _, _, s, _ in got.values()}
    assert {"CLOSED", "EXHAUSTED", "WAITING"} <= statuses
    whole = {r.pid: (r.entry_date, r.round, r.status, r.closed_on_round) for r in escalate_on_time(stream, cards, status, LATENCY, DELAY, f"file://{tmp_path}/again").collect()}
    assert whole == got


def test_lookbacks_keep_the_time_of_day(spark):
    index = dt.datetime(2024, 1, 31, 12)
    panel = spark.createDataFrame([(1, index)], "pid long, index_date timestamp")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1), 1.0), (1, dt.datetime(2024, 1, 1, 13), 2.0), (1, index, 3.0)], "pid long, date timestamp, value double")
    assert [r.value for r in C.pre_index_rows(rows, panel, "date", 30).collect()] == [2.0]
    dated = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0), (1, dt.date(2023, 12, 31), 2.0)], "pid long, date date, value double")
    assert [r.value for r in C.pre_index_rows(dated, spark.createDataFrame([(1, index.date())], "pid long, index_date date"), "date", 30).collect()] == [1.0]
