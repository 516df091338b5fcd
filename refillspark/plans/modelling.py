"""Queries over models, files and streams; where SQL can't express one, tests check its properties."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources as S
from .. import streaming as T
from ..operators import escalation as X
from ..operators import models as M
from ..operators import routing as O
from ..operators import windows as W
from . import features as base
from . import lifecycle as L
from . import routing as R
from .lens import with_frames

Q: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["cmb_n_conditions", "rx_n_active_meds", "rx_n_meds_started_1y", "engage_n_encounters", "sbp_mean", "sbp_latest_reading"]


def query(name: str, sql: str | None = None):
    def add(f):
        base.query(name, sql)(f)
        Q[name] = base.Q.pop(name)
        if sql:
            SQL[name] = base.SQL.pop(name)
        return f

    return add


def _panel(z):
    """Features and label of each subject, imputed; the cohort and each part are stored, so that no task sorts the rows of several."""
    z = z.with_stored_cohort()
    panel = z.rows_by_subject(z.cohort())
    for part in (base.comorbidity(z), base.regimen(z), base.engagement(z), base.trajectory(z).select("pid", "sbp_mean", "sbp_latest_reading"), base.gaps(z).select("pid", "has_30_day_gap"), base.pdc(z)):
        panel = panel.join(z.rows_by_subject(T.kept(part, "part")), "pid")
    label = (F.col("pdc_180d") > F.lit(0.3)).cast("int")
    return M.impute_with_indicator(T.kept(panel.withColumn("event", label), "panel"), FEATURES)


@query(
    "m1_impute_with_indicator",
    with_frames(
        base._trajectory_sql(base.CHANNELS, "AND date >= index_date - 1095") + """, j AS (SELECT c.pid, sbp_mean FROM cohort c LEFT JOIN t USING (pid))
        SELECT pid, round(coalesce(sbp_mean, (SELECT quantile_cont(sbp_mean, 0.5) FROM j), 0), 6) AS sbp_mean, (sbp_mean IS NULL)::INT AS sbp_mean_missing FROM j""",
        "observations", "cohort",
    ),
)
def _(z):
    # Stored: the passes of the median would each work it out anew.
    means = T.kept(base.trajectory(z).select("pid", "sbp_mean"), "means")
    return M.impute_with_indicator(means, ["sbp_mean"]).withColumn("sbp_mean", F.round("sbp_mean", 6))


@query("m2_logistic_scores")
def _(z):
    panel = _panel(z)
    return M.score_holdout(M.fit_logistic(panel, FEATURES, "event"), panel, FEATURES)


@query("m3_gbt_scores")
def _(z):
    panel = _panel(z)
    return M.score_holdout(M.fit_gbt(panel, FEATURES, "event", 8), panel, FEATURES)


@query("m4_random_forest_scores")
def _(z):
    panel = _panel(z)
    return M.score_holdout(M.fit_random_forest(panel, FEATURES, "event"), panel, FEATURES)


@query("m5_out_of_fold_scores")
def _(z):
    rows = T.kept(W.stratified_folds(_panel(z)), "folds")  # each fit and score reads them
    return M.out_of_fold_scores(rows, FEATURES, "event", M.fit_logistic)


@query("m6_score_holdout")
def _(z):
    split = W.temporal_split(z.cohort()).select("pid", "split")
    panel = T.kept(_panel(z).join(split, "pid"), "split")
    model = M.fit_logistic(panel.where("split = 'train'"), FEATURES, "event")
    return M.score_holdout(model, panel.where("split = 'test'"), FEATURES)


@query("m8_tree_attribution")
def _(z):
    panel = _panel(z)
    return M.tree_attribution(panel, M.fit_gbt(panel, FEATURES, "event", 5, 3), FEATURES)


@query("m10_aft_survival")
def _(z):
    panel = _panel(z).withColumn("time", F.greatest(F.col("pdc_180d") * 180, F.lit(1.0)))
    model = M.fit_aft_survival(panel, FEATURES)
    return model.transform(panel).select("pid", F.round(-F.col("prediction"), 6).alias("risk"))


# Fitted scores aren't SQL's, but what holds for each of them is: who is scored, and what the fit's own equations say of the scores.
_LABELLED = base._IV + base._SWEEP + base._A1 + ", panel AS (SELECT pid, index_date, (pdc_180d > 0.3)::INT AS event, pdc_180d FROM cohort JOIN pdc USING (pid))"
_PROPERTIES = " SELECT count(*) AS n, sum(event)::BIGINT AS n_events, count(*) AS n_scored, 1 AS events_score_higher{} FROM panel"


def _scored(scores, panel):
    """Rows, events, scores that are probabilities, and whether the events' mean score is the higher one."""
    event, score = F.col("event") == 1, F.col("score")
    higher = F.avg(F.when(event, score)) > F.avg(F.when(~event, score))
    return [F.count("*").alias("n"), F.sum("event").alias("n_events"), F.count_if(score.between(0, 1)).alias("n_scored"), higher.cast("int").alias("events_score_higher")], scores.join(panel.select("pid", "event"), "pid")


# Balanced weights and a free intercept: the weighted mean score is the weighted share of events, a half.
@query("m2_logistic_properties", with_frames(_LABELLED + _PROPERTIES.format(", 0.5::DOUBLE AS weighted_mean"), "fills", "cohort"))
def _(z):
    panel = _panel(z)
    columns, rows = _scored(M.score_holdout(M.fit_logistic(panel, FEATURES, "event"), panel, FEATURES), panel)
    mean = F.sum(F.col("weight") * F.col("score")) / F.sum("weight")
    return M.balanced_weights(rows, "event").agg(*columns, F.round(mean, 3).alias("weighted_mean"))


@query("m3_gbt_properties", with_frames(_LABELLED + _PROPERTIES.format(""), "fills", "cohort"))
def _(z):
    panel = _panel(z)
    columns, rows = _scored(M.score_holdout(M.fit_gbt(panel, FEATURES, "event", 8), panel, FEATURES), panel)
    return rows.agg(*columns)


@query("m4_random_forest_properties", with_frames(_LABELLED + _PROPERTIES.format(""), "fills", "cohort"))
def _(z):
    panel = _panel(z)
    columns, rows = _scored(M.score_holdout(M.fit_random_forest(panel, FEATURES, "event"), panel, FEATURES), panel)
    return rows.agg(*columns)


# Each row in the fold that the order of its hash gives it, and scored there once.
@query(
    "m5_out_of_fold_rows",
    with_frames(
        _LABELLED + """ SELECT pid, event, ((row_number() OVER (PARTITION BY event ORDER BY md5(pid::VARCHAR || '|42'), pid) - 1) % 5)::INT AS fold,
        1::BIGINT AS n_scores, 1 AS is_probability FROM panel""",
        "fills", "cohort",
    ),
)
def _(z):
    rows = T.kept(W.stratified_folds(_panel(z)), "folds")
    scores = M.out_of_fold_scores(rows, FEATURES, "event", M.fit_logistic).join(rows.select("pid", "event"), "pid")
    return scores.groupBy("pid", "event", "fold").agg(F.count("*").alias("n_scores"), F.min(F.col("score").between(0, 1).cast("int")).alias("is_probability"))


# A frozen model scores the rows it is given and no others.
@query("m6_holdout_rows", with_frames(R._SPLIT + " SELECT pid, split, (split = 'test')::INT AS is_scored FROM split", "cohort"))
def _(z):
    split = W.temporal_split(z.cohort()).select("pid", "split")
    panel = T.kept(_panel(z).join(split, "pid"), "split")
    model = M.fit_logistic(panel.where("split = 'train'"), FEATURES, "event")
    scores = M.score_holdout(model, panel.where("split = 'test'"), FEATURES).select("pid", F.col("score").between(0, 1).cast("int").alias("is_scored"))
    return split.join(scores, "pid", "left").na.fill(0, ["is_scored"])


# Additive to the model's own margin, which Spark ML gives as the raw prediction; one base for all rows.
@query("m8_tree_attribution_additive", with_frames(_LABELLED + " SELECT pid, 0.0::DOUBLE AS rest, 1::BIGINT AS n_bases FROM panel", "fills", "cohort"))
def _(z):
    panel = _panel(z)
    model = M.fit_gbt(panel, FEATURES, "event", 5, 3)
    rows = T.kept(M.tree_attribution(panel, model, FEATURES), "attributions")
    raw = model.transform(panel.select("pid", *FEATURES)).select("pid", vector_to_array("rawPrediction")[1].alias("raw"))
    parts = sum((F.col(f"{c}_attr") for c in FEATURES), F.col("base"))
    bases = rows.agg(F.countDistinct(F.round("base", 9)).alias("n_bases"))
    return rows.join(raw, "pid").select("pid", F.abs(F.round(F.col("raw") - parts, 6)).alias("rest")).join(F.broadcast(bases))


# At the best fit of the times the expected events of all rows are as many as those observed.
@query(
    "m10_aft_survival_properties",
    with_frames(_LABELLED + " SELECT count(*) AS n, sum(event)::BIGINT AS n_events, count(*) AS n_times, 1.0::DOUBLE AS expected_over_observed FROM panel", "fills", "cohort"),
)
def _(z):
    panel = _panel(z).withColumn("time", F.greatest(F.col("pdc_180d") * 180, F.lit(1.0)))
    model = M.fit_aft_survival(panel, FEATURES)
    expected = F.sum(F.pow(F.col("time") / F.col("prediction"), F.lit(1.0 / model.stages[-1].scale)))
    rows = model.transform(panel)
    return rows.agg(F.count("*").alias("n"), F.sum("event").alias("n_events"), F.count_if(F.col("prediction") > 0).alias("n_times"), F.round(expected / F.sum("event"), 2).alias("expected_over_observed"))


# ---- files --------------------------------------------------------------------------------------


@query("s1_ingest_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(z):
    path = T.new_path(z.spark, "csv")
    z.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(f"{path}/customer.csv")
    S.ingest_csv(z.spark, f"{path}/customer.csv", f"{path}/customer.parquet", ["c_custkey"])
    return z.spark.read.parquet(f"{path}/customer.parquet")


@query("s2_ingest_csv_all_string", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_size::VARCHAR AS p_size FROM part")
def _(z):
    path = T.new_path(z.spark, "csv")
    z.table("part").select("p_partkey", "p_brand", "p_size").write.option("header", True).csv(f"{path}/part.csv")
    S.ingest_csv_all_string(z.spark, f"{path}/part.csv", f"{path}/part.parquet")
    return z.spark.read.parquet(f"{path}/part.parquet")


@query("s3_ingest_directory", 'SELECT \'customer\' AS "table", count(*) AS rows FROM customer UNION ALL SELECT \'supplier\', count(*) FROM supplier')
def _(z):
    path = T.new_path(z.spark, "csv")
    for name in ("customer", "supplier", "nation"):
        z.table(name).write.option("header", True).csv(f"{path}/{name}.csv")
    return S.ingest_directory(z.spark, path, f"{path}/out", ["customer", "supplier", "nation"], exclude=["nation"], all_string=["supplier"], force_string=["c_custkey"])


@query("s4_materialize_code_subset", with_frames(" SELECT * FROM observations WHERE code = 'A'", "observations"))
def _(z):
    return S.materialize_code_subset(z.observations(), ["A"], T.new_path(z.spark, "subset"))


@query("s12_snapshot", with_frames(R.WORKLIST_SQL + " SELECT pid, role, score, included FROM worklist", *R.WORKLIST_FRAMES))
def _(z):
    path, cards = T.new_path(z.spark, "snapshot"), R.worklist(z).select("pid", "role", "score", "included")
    S.write_snapshot(cards, path, "json")
    return S.read_snapshot(z.spark, path, cards.schema, "json")


# ---- streams ------------------------------------------------------------------------------------


def as_replay(df: DataFrame, order: str, files: int) -> DataFrame:
    """The rows as a stream that brings ``files`` files one after the other, in the order of a column: a feed for replays."""
    path = T.new_path(df.sparkSession, "replay")
    ends = df.agg(F.min(F.unix_micros(order)).alias("a"), F.max(F.unix_micros(order)).alias("b")).first()
    place = F.lit(0) if ends["a"] is None else F.floor((F.unix_micros(order) - ends["a"]) * files / max(1, ends["b"] - ends["a"] + 1))
    for i in range(files):  # one write after the other: a stream takes files by their time
        df.where(F.coalesce(place, F.lit(0)) == i).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream(z, files: int):
    events = z.table("events").select(F.col("user_id").alias("pid"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("is_dispense"))
    return as_replay(events, "ts", files)


def _file_sql(files: int) -> str:
    """The file (from 0) of an event in a replay."""
    return f"((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {files} // (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events))"


@query("t5_stream_reveal", f"SELECT user_id AS pid, min(ts) AS ts, min({_file_sql(4)})::INT AS batch FROM events GROUP BY 1")
def _(z):
    return T.reveal(_stream(z, 4)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_REVEALED = R.WORKLIST_SQL.replace("JOIN scores USING (pid)", "JOIN scores USING (pid) WHERE pid IN (SELECT user_id FROM events)")


def _routed(z, known):
    return O.build_worklist(R.decided(z).join(known, "pid", "left_semi"), z.scores(), R._caps(z))


@query("t6_stream_score_and_route", with_frames(_REVEALED + " SELECT pid, role, rank_in_role, included FROM worklist", *R.WORKLIST_FRAMES))
def _(z):
    return T.score_and_route(_stream(z, 3), lambda known: _routed(z, known).select("pid", "role", "rank_in_role", "included"))


def model_route(z):
    """A route whose scores come from a model that is fitted once, before the stream starts."""
    panel = _panel(z)
    model = M.fit_logistic(panel, FEATURES, "event")

    def route(known):
        scores = M.score_holdout(model, panel.join(known, "pid", "left_semi"), FEATURES).withColumnRenamed("score", "risk")
        scores = scores.join(z.subjects().select("pid", "stratum"), "pid")
        return O.build_worklist(R.decided(z), scores, R._caps(z)).select("pid", "risk", "role", "score", "rank_in_role", "included")

    return route


# Fitted risks aren't SQL's; of the ranks it can say that each role has all of them, and how many the caps take.
@query(
    "t6_stream_model",
    with_frames(
        R.WORKLIST_SQL + f""", r AS (SELECT action AS role, is_safety FROM decided WHERE pid IN (SELECT user_id FROM events) AND pid IN (SELECT pid FROM cohort))
        SELECT role, count(*) AS n, count(*) AS n_scored, count(*) AS n_ranks, count(*)::INT AS last_rank, least(count(*), greatest(coalesce(any_value(cap), count(*)), sum(is_safety)))::BIGINT AS n_included
        FROM r LEFT JOIN caps USING (role) GROUP BY role""",
        *R.WORKLIST_FRAMES, "cohort",
    ),
)
def _(z):
    last = T.score_and_route(_stream(z, 3), model_route(z)).groupBy("role")
    return last.agg(F.count("*").alias("n"), F.count_if(F.col("risk").between(0, 1)).alias("n_scored"), F.countDistinct("rank_in_role").alias("n_ranks"), F.max("rank_in_role").alias("last_rank"), F.sum("included").alias("n_included"))


#: The day of the first tick in the cards' calendar, and the days from a tick to the next.
FIRST_TICK, TICK_DAYS = "2000-12-15", 30


def tick_day(number: int) -> str:
    return str(dt.date.fromisoformat(FIRST_TICK) + dt.timedelta(days=TICK_DAYS * number))


_STATE_COLUMNS = ["pid", "entry_date", "days_to_break", "driver", "is_safety", "round", "status", "closed_on_round", "dispatch_dates", "as_of"]


def advance_by_ticks(z):
    """A tick of the streamed escalation: the revealed are routed anew, and their states move on to the tick's day."""
    status = L._status(z)

    def advance(known, outcomes, prior, number):
        cards = T.kept(_routed(z, known), "cards")
        filled = outcomes.select("pid", F.lit(1).alias("observed"), F.lit(1).alias("on_time_refill"), F.date_sub("event_date", L.SHIFT).alias("event_date"))
        states = X.advance_state(cards, filled, status, prior, tick_day(number), L.LATENCY).select(*_STATE_COLUMNS)
        return states.join(cards.select("pid", "rank_in_role", "included"), "pid")

    return advance


# The state after three ticks, from all events at once: a subject enters on the day of the tick that reveals it.
_ENTERED = f", entered AS (SELECT w.pid, driver, is_safety, days_to_break, rank_in_role, included, DATE '{FIRST_TICK}' + ({TICK_DAYS} * tick)::INT AS entry_date FROM worklist w JOIN (SELECT user_id AS pid, min({_file_sql(3)}) AS tick FROM events GROUP BY 1) USING (pid))"
_BOUGHT = f", seen AS (SELECT user_id AS pid, 1 AS observed, 1 AS on_time_refill, min(ts)::DATE - {L.SHIFT} AS event_date FROM events WHERE event_type = 'purchase' GROUP BY 1)"
_LAST = (_REVEALED + _ENTERED + L._schedule_sql("entered", "sched") + _BOUGHT + L._STATUS + L._state_sql(tick_day(2)) + f""", went AS (SELECT pid, count(*) AS n FROM (SELECT *, unnest([0, 1, 2]) AS r FROM states)
    WHERE r <= round AND r >= is_safety AND (internal_allowed = 1 OR (r = 1 AND is_safety = 0 AND driver IN ('transport', 'access')))
    AND (r < round OR status = 'PENDING' OR (status <> 'WAITING' AND ref >= {L._PICK('wait').replace('CASE round', 'CASE r')})) GROUP BY pid)""")  # fmt: skip


@query(
    "t7_stream_escalation",
    with_frames(
        _LAST + """ SELECT pid, entry_date, round, CASE WHEN status = 'PENDING' THEN 'DISPATCHED' ELSE status END AS status, CASE WHEN status = 'CLOSED' THEN round END AS closed_on_round,
        coalesce(n, 0)::INT AS n_dispatched, rank_in_role, included FROM states LEFT JOIN went USING (pid)""",
        *R.WORKLIST_FRAMES, "subjects", "consent",
    ),
)
def _(z):
    return T.escalate(_stream(z, 3), advance_by_ticks(z)).select("pid", "entry_date", "round", "status", "closed_on_round", F.size("dispatch_dates").alias("n_dispatched"), "rank_in_role", "included")


# By timers: dispenses are the larger purchases, and the watermark lies a day behind the latest event.
_TIMED = (
    R.WORKLIST_SQL + f""", ev AS (SELECT user_id AS pid, ts - INTERVAL {L.SHIFT} DAY AS ts, event_type = 'purchase' AND value > 150 AS bought, {_file_sql(6)} AS file FROM events),
    firsts AS (SELECT pid, min(file) AS file FROM ev GROUP BY pid), came AS (SELECT pid, min(ts)::DATE AS entry_date FROM ev JOIN firsts USING (pid, file) GROUP BY pid),
    latest AS (SELECT pid, greatest(max(ts)::DATE, ((SELECT max(ts) FROM ev) - INTERVAL 1 DAY)::DATE) AS as_of FROM ev GROUP BY pid),
    seen AS (SELECT pid, 1 AS observed, 1 AS on_time_refill, min(ts)::DATE AS event_date FROM ev WHERE bought GROUP BY pid),
    entered AS (SELECT w.pid, driver, is_safety, days_to_break, entry_date, as_of FROM worklist w JOIN came USING (pid) JOIN latest USING (pid))"""
    + L._schedule_sql("entered", "sched") + L._STATUS + L._state_sql("1970-01-01").replace("DATE '1970-01-01'", "as_of")
)


@query(
    "t7_stream_timers",
    with_frames(_TIMED + " SELECT pid, entry_date, round, CASE WHEN status = 'PENDING' THEN 'DISPATCHED' ELSE status END AS status, CASE WHEN status = 'CLOSED' THEN round END AS closed_on_round FROM states", *R.WORKLIST_FRAMES, "subjects", "consent"),
)
def _(z):
    from ..streaming.timers import escalate_on_time

    ts = F.col("ts").cast("timestamp") - F.expr(f"INTERVAL '{L.SHIFT}' DAY")
    bought = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    events = z.table("events").select(F.col("user_id").alias("pid"), ts.alias("ts"), bought.cast("int").alias("is_dispense"))
    states = escalate_on_time(as_replay(events, "ts", 6), T.kept(R.worklist(z), "cards"), L._status(z), L.LATENCY, 1)
    return states.select("pid", "entry_date", "round", "status", "closed_on_round")


@query("t8_latency_guard", """SELECT ts::DATE::TIMESTAMP AS day, count(*) AS n, sum((event_type = 'purchase')::INT)::BIGINT AS n_dispensed FROM events
    GROUP BY 1 HAVING ts::DATE::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 14 DAY""".replace("HAVING ts::DATE::TIMESTAMP", "HAVING day"))  # fmt: skip
def _(z):
    return T.drained(T.latency_guard(_stream(z, 5), 14)).withColumn("day", F.col("day").cast("timestamp_ntz"))


# Events arrive by id here, a fifth in each file, so that many come after their day was closed.
@query(
    "t8_latency_counts",
    """WITH e AS (SELECT *, ts::DATE::TIMESTAMP AS day, (event_id - (SELECT min(event_id) FROM events)) * 5 // (SELECT max(event_id) - min(event_id) + 1 FROM events) AS file FROM events),
    before AS (SELECT f.file, max(e.ts) AS latest FROM (SELECT DISTINCT file FROM e) f LEFT JOIN e ON e.file < f.file GROUP BY f.file)
    SELECT day, count(*) AS n, sum((event_type = 'purchase')::INT)::BIGINT AS n_dispensed, count(*) FILTER (day + INTERVAL 3 DAY <= latest) AS n_late, (day + INTERVAL 3 DAY <= (SELECT max(ts) FROM events))::INT AS final
    FROM e JOIN before USING (file) GROUP BY day""",
)
def _(z):
    events = z.table("events").select(F.timestamp_micros("event_id").alias("at"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("is_dispense"))
    return T.latency_counts(as_replay(events, "at", 5), 2).withColumn("day", F.col("day").cast("timestamp_ntz"))
