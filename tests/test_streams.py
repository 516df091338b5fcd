"""Streams against batches: lasting outcomes, restarts, late rows, frozen models."""

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from refillspark import streaming as T  # noqa: E402
from refillspark.operators import escalation as X  # noqa: E402
from refillspark.operators import routing as R  # noqa: E402
from refillspark.operators import windows as W  # noqa: E402
from refillspark.plans import modelling  # noqa: E402
from refillspark.plans.lens import Lens  # noqa: E402

SF = "/root/testdata/sf0.001"
SHAPE = "pid long, ts timestamp, is_dispense int"


def day(n, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def source(spark, folder, ticks):
    """A stream of one file a tick; more files may follow later."""
    path = f"file://{folder}/in"
    for rows in ticks:
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)


TICKS = [
    [(1, day(0), 0), (2, day(1), 1), (3, day(2), 0), (None, day(2), 1)],
    [(1, day(10), 1), (3, day(11), 0), (4, day(12), 0)],
    [(3, day(20), 0), (4, day(21), 0), (5, day(22), 1), (2, day(23), 1)],
    [(3, day(30), 0)],
]


def advancing(spark, fail_at=None):
    cards = spark.createDataFrame([(p, "cost", int(p == 4), 90.0 - 10 * p) for p in range(1, 7)], "pid long, driver string, is_safety int, days_to_break double")
    status = spark.createDataFrame([(p, "granted", "granted", 0, 1, 1) for p in range(1, 7)], "pid long, internal string, external string, stale int, internal_allowed int, external_allowed int")

    def advance(known, outcomes, prior, number):
        filled = outcomes.select("pid", F.lit(1).alias("observed"), F.lit(1).alias("on_time_refill"), "event_date")
        today = str((day(10) + dt.timedelta(days=30 * number)).date())
        out = X.advance_state(cards.join(known, "pid", "left_semi"), filled, status, prior, today, 7)
        if number == fail_at:  # after a part of the version has been written
            out.limit(1).write.mode("overwrite").parquet(f"{root['of']}/versions/{number}")
            raise RuntimeError("killed")
        return out.select("pid", "entry_date", "days_to_break", "driver", "is_safety", "round", "status", "closed_on_round", "dispatch_dates", "as_of")

    root = {}
    return advance, root


def rows(df):
    return sorted((tuple(sorted(r.asDict().items(), key=str)) for r in df.withColumn("dispatch_dates", F.col("dispatch_dates").cast("string")).collect()), key=str)


def test_closed_loops_stay_closed(spark, tmp_path):
    advance, _ = advancing(spark)
    out = {r.pid: r for r in T.escalate(source(spark, tmp_path, TICKS), advance, f"file://{tmp_path}/root").collect()}
    assert set(out) == {1, 2, 3, 4, 5}  # the revealed, and no one else
    assert {p for p, r in out.items() if r.status == "CLOSED"} == {1, 2, 5}
    versions = T.Versions(spark, f"file://{tmp_path}/root")
    assert versions.complete() == [0, 1, 2, 3]
    for p in (1, 2, 5):
        closed = [(r.status, r.closed_on_round) for v in range(4) for r in versions.read(v).where(F.col("pid") == p).collect()]
        first = next(i for i, (s, _) in enumerate(closed) if s == "CLOSED")
        assert len(set(closed[first:])) == 1  # closed on one round from then on
    entered = {p: str(r.entry_date) for p, r in out.items()}
    assert entered[1] == entered[2] == entered[3] == "2024-01-11" and entered[4] == "2024-02-10" and entered[5] == "2024-03-11"


def test_the_last_tick_equals_a_batch_over_all(spark, tmp_path):
    advance, _ = advancing(spark)
    streamed = T.escalate(source(spark, tmp_path, TICKS), advance, f"file://{tmp_path}/root")
    flat = spark.createDataFrame([r for t in TICKS for r in t], SHAPE).where("pid is not null")
    outcomes = flat.where("is_dispense = 1").groupBy("pid").agg(F.min(F.to_date("ts")).alias("event_date"))
    prior = None
    for n in range(4):
        known = spark.createDataFrame([r for t in TICKS[: n + 1] for r in t], SHAPE).where("pid is not null").select("pid").distinct()
        prior = T.kept(advance(known, outcomes.join(known, "pid", "left_semi"), prior, n), "batch")
    # Outcomes known earlier than their tick only change what was dispatched before them.
    assert [r[:1] + r[2:] for r in sorted((r.pid, str(r.dispatch_dates), r.status, r.round, r.closed_on_round, r.entry_date) for r in streamed.collect())] == [
        r[:1] + r[2:] for r in sorted((r.pid, str(r.dispatch_dates), r.status, r.round, r.closed_on_round, r.entry_date) for r in prior.collect())
    ]


@pytest.mark.parametrize("fail_at", [0, 2])
def test_a_killed_stream_goes_on(spark, tmp_path, fail_at):
    whole, _ = advancing(spark)
    (tmp_path / "a").mkdir()
    want = rows(T.escalate(source(spark, tmp_path / "a", TICKS), whole, f"file://{tmp_path}/a/root"))
    failing, root = advancing(spark, fail_at)
    root["of"] = f"file://{tmp_path}/b/root"
    stream = source(spark, tmp_path / "b", TICKS)
    with pytest.raises(Exception, match="killed"):
        T.escalate(stream, failing, root["of"])
    assert T.Versions(spark, root["of"]).complete() == list(range(fail_at))
    assert rows(T.escalate(stream, whole, root["of"])) == want
    assert rows(T.escalate(stream, whole, root["of"])) == want  # nothing new: the newest version
    source(spark, tmp_path / "b", [[(3, day(40), 1)]])
    again = {r.pid: r.status for r in T.escalate(stream, whole, root["of"]).collect()}
    assert again[3] == "CLOSED" and again[1] == "CLOSED"


def test_streams_without_rows(spark, tmp_path):
    advance, _ = advancing(spark)
    empty = source(spark, tmp_path, [[]])
    assert T.escalate(empty, advance).count() == 0
    assert T.score_and_route(empty, lambda known: known).count() == 0
    assert T.reveal(empty).count() == 0 and T.latency_counts(empty, 3).count() == 0


def test_each_subject_is_revealed_once_also_by_late_rows(spark, tmp_path):
    ticks = [*TICKS, [(7, day(-300), 0), (1, day(-300), 0)]]
    stream, root = source(spark, tmp_path, ticks[:3]), f"file://{tmp_path}/root"
    assert {(r.pid, r.batch) for r in T.reveal(stream, root).collect()} == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 2)}
    source(spark, tmp_path, ticks[3:])
    assert {(r.pid, r.batch) for r in T.reveal(stream, root).collect()} == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (7, 4)}


def test_late_rows_are_counted(spark, tmp_path):
    ticks = [[(1, day(0), 1), (1, day(1), 0)], [(1, day(9), 1), (1, day(0), 1)], [(1, day(0, 1), 1), (1, day(8), 0), (1, None, 1)]]
    got = {r.day.day: (r.n, r.n_dispensed, r.n_late, r.final) for r in T.latency_counts(source(spark, tmp_path, ticks), 5).collect()}
    # The second file's row of day 0 still counts: what was seen before it ends on day 1.
    assert got == {1: (3, 3, 1, 1), 2: (1, 0, 0, 1), 9: (1, 0, 0, 0), 10: (1, 1, 0, 0)}


def test_every_trigger_ranks_as_a_batch_does(spark, tmp_path):
    z = Lens(spark, SF)
    route, root = modelling.model_route(z), f"file://{tmp_path}/routed"
    T.score_and_route(modelling._stream(z, 3), route, root)
    versions = T.Versions(spark, root)
    assert versions.complete() == [0, 1, 2]
    for v in (0, 2):
        known = versions.read(v, "seen").select("pid")
        got, want = (sorted(map(tuple, df.collect())) for df in (versions.read(v), route(known)))
        assert got == want and len(got) > 10 and len({r[1] for r in got}) > 5


# ---- null keys ----------------------------------------------------------------------------------


def test_no_ranking_loses_rows_to_null_keys(spark):
    cards = spark.createDataFrame(
        [(i, [None, "a", "b"][i % 3], [None, 0, 1][i % 4 % 3], None if i % 5 == 0 else i / 10, "s") for i in range(60)], "pid long, role string, needs_review int, score double, stratum string"
    )
    ranked = W.rank_in_role(cards)
    by_role = {}
    for r in ranked.collect():
        by_role.setdefault(r.role, []).append(r)
    assert {k: sorted(r.rank_in_role for r in v) for k, v in by_role.items()} == {k: list(range(1, 21)) for k in (None, "a", "b")}
    for found in by_role.values():
        order = [(r.needs_review == 1, r.score is not None, r.score or 0) for r in sorted(found, key=lambda r: r.rank_in_role)]
        assert order == sorted(order, reverse=True)
    caps = spark.createDataFrame([("a", 3), ("b", None), (None, 1)], "role string, cap int")
    capped = W.apply_caps(ranked, caps).collect()
    assert len(capped) == 60 and {r.role: r.effective_cap for r in capped} == {None: 20, "b": 20, "a": max(3, sum(r.needs_review == 1 for r in by_role["a"]))}
    assert all(r.expanded == (r.role == "a" and r.needs_review == 1) for r in capped)
    meta = R.worklist_meta(W.apply_caps(ranked, caps), caps).first()
    assert meta.cohort_size == 60 and set(meta.caps_used) == {"a", "b"} and meta.capacity == sum({r.role: r.effective_cap for r in capped}.values())
    labelled = spark.createDataFrame([(i, [None, 0, 1][i % 3]) for i in range(30)], "pid long, event int")
    folds = W.stratified_folds(labelled, k=5).collect()
    assert len(folds) == 30 and {(r.event, r.fold) for r in folds} == {(e, f) for e in (None, 0, 1) for f in range(5)}


def test_a_driver_without_a_rule_is_an_error(spark):
    rules = R.rules_table(spark)
    fallbacks = spark.createDataFrame([("regimen", "bp_trend")], "driver string, fallback string")
    rows = [(1, "transport", 2.0, 0.0), (2, "cost", 2.0, 0.0)]
    with pytest.raises(Exception, match="no rule for driver transport"):
        R.decide(spark.createDataFrame(rows, "pid long, driver string, value double, raw double"), rules, fallbacks).collect()
    assert R.decide(spark.createDataFrame(rows[1:], "pid long, driver string, value double, raw double"), rules, fallbacks).count() == 1
