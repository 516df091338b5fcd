"""Queries over cohorts, coverage and features, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as S
from ..operators import cohort as C
from ..operators import coverage as V
from ..operators import features as X
from ..storage import kept
from .lens import AS_OF, INDEX_CODES, Lens, with_frames

DX = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23", "Brand#31", "Brand#32")
GROUPS = {"isolation": ("Brand#11", "Brand#21"), "housing": ("Brand#12",), "trauma": ("Brand#13", "Brand#31", "Brand#41")}
CHANNELS = {"sbp": "A", "dbp": "R"}
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Lens, and its SQL."""

    def add(f):
        Q[name] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _groups(z: Lens):
    return z.spark.createDataFrame([(g, c) for g, codes in GROUPS.items() for c in codes], "code_group string, code string")


# ---- scalar functions ---------------------------------------------------------------------------


@query(
    "f1_parse_dates",
    """SELECT event_id, try_cast(raw AS TIMESTAMP) AS ts_parsed, try_cast(raw AS TIMESTAMP)::DATE AS day_parsed FROM
       (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events)""",
)
def _(z):
    raw = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = z.table("events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", S.parse_ts(F.col("raw")).cast("timestamp_ntz").alias("ts_parsed"), S.parse_day(F.col("raw")).alias("day_parsed"))


@query("f2_to_number", "SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'abc' ELSE event_id::VARCHAR END AS DOUBLE) AS number FROM events")
def _(z):
    return z.table("events").select("event_id", S.to_number(F.when(F.col("event_id") % 7 == 0, "abc").otherwise(F.col("event_id").cast("string"))).alias("number"))


@query("f3_empty_to_null", "SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS kind FROM events")
def _(z):
    return z.table("events").select("event_id", S.empty_to_null(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))).alias("kind"))


@query("f4_age_years", with_frames(f" SELECT pid, floor((coalesce(death, DATE '{AS_OF}') - birth) / 365.25)::INT AS age FROM subjects", "subjects"))
def _(z):
    return z.subjects().select("pid", S.age_years(F.col("birth"), F.col("death"), F.to_date(F.lit(AS_OF))).alias("age"))


@query("f5_elapsed_days", "SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000)::BIGINT AS days FROM events")
def _(z):
    return z.table("events").select("event_id", S.elapsed_days(F.to_timestamp(F.lit("2024-01-15 12:00:00")), F.col("ts")).alias("days"))


@query("f6_coverage_end", with_frames(" SELECT encounter, CASE WHEN stop > start THEN stop ELSE start + 30 END AS covered_to FROM fills", "fills"))
def _(z):
    return z.fills().select("encounter", S.coverage_end(F.col("start"), F.col("stop")).alias("covered_to"))


@query(
    "f7_clip_interval",
    with_frames(
        """ SELECT encounter, greatest(start, DATE '1998-01-01') AS cs, least(CASE WHEN stop > start THEN stop ELSE start + 30 END, DATE '1999-01-01') AS ce FROM fills
        WHERE greatest(start, DATE '1998-01-01') < least(CASE WHEN stop > start THEN stop ELSE start + 30 END, DATE '1999-01-01')""",
        "fills",
    ),
)
def _(z):
    cs, ce = S.clip_interval(F.col("start"), S.coverage_end(F.col("start"), F.col("stop")), F.to_date(F.lit("1998-01-01")), F.to_date(F.lit("1999-01-01")))
    return z.fills().select("encounter", cs.alias("cs"), ce.alias("ce")).where("cs < ce")


@query(
    "f8_min_max_scale",
    """SELECT c_custkey, round(CASE WHEN hi > lo THEN 0.1 + (c_acctbal - lo) / (hi - lo) * 0.9 ELSE 1.0 END, 6) AS scaled
       FROM (SELECT *, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment))""",
)
def _(z):
    return S.min_max_scale(z.table("customer"), F.col("c_acctbal"), "c_mktsegment", "scaled").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query(
    "f9_hash_bucket",
    """SELECT c_custkey, list_reduce(list_prepend(0, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', sha1(c_custkey::VARCHAR)[i]) - 1)),
       lambda a, d: (a * 16 + d) % 100)::INT AS bucket FROM customer""",
)
def _(z):
    return z.table("customer").select("c_custkey", S.hash_bucket(F.col("c_custkey")).alias("bucket"))


@query("f10_render_template", "SELECT c_custkey, 'Dear ' || c_name || ', segment ' || c_mktsegment || '.' AS body FROM customer")
def _(z):
    return z.table("customer").select("c_custkey", S.render_template(F.lit("Dear {name}, segment {segment}."), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("body"))


@query("f11_deid_ref", "SELECT c_custkey, 'Patient #' || substring(c_name, 1, 8) AS ref FROM customer")
def _(z):
    return z.table("customer").select("c_custkey", S.deid_ref(F.col("c_name")).alias("ref"))


@query(
    "f12_display_window",
    with_frames(f" SELECT pid, DATE '{AS_OF}' + floor(greatest((1 - risk) * 180 - 3, 0))::INT AS window_start, DATE '{AS_OF}' + floor((1 - risk) * 180 + 3)::INT AS window_end FROM scores", "scores"),
)
def _(z):
    start, end = S.display_window(F.to_date(F.lit(AS_OF)), (1 - F.col("risk")) * 180)
    return z.scores().select("pid", start.alias("window_start"), end.alias("window_end"))


# ---- cohorts ------------------------------------------------------------------------------------

_DX = f", dx AS (SELECT DISTINCT pid FROM conditions WHERE code IN {_in(DX)})"
_RX = f", rx AS (SELECT DISTINCT pid FROM fills WHERE code IN {_in(INDEX_CODES)})"
_IDX = f""", gaps AS (SELECT pid, start, start - lag(start) OVER (PARTITION BY pid ORDER BY start) AS gap FROM fills WHERE code IN {_in(INDEX_CODES)}),
    idx AS (SELECT pid, min(start) AS index_date FROM gaps WHERE gap IS NULL OR gap > 365 GROUP BY pid)"""
_ELIG = ", elig AS (SELECT * FROM idx WHERE EXISTS (SELECT 1 FROM observations o WHERE o.pid = idx.pid AND o.code = 'A' AND o.date < index_date AND o.date >= index_date - 1095))"


def _dx(z):
    return C.subjects_with_code(z.conditions(), DX)


def _rx(z):
    return C.subjects_with_code(z.fills(), INDEX_CODES)


def _idx(z):
    return C.incident_index_date(z.fills(), INDEX_CODES)


@query("j1_subjects_with_code", with_frames(_DX + " SELECT pid FROM dx", "conditions"))
def _(z):
    return _dx(z)


@query("j2_cohort_intersection", with_frames(_DX + _RX + " SELECT pid FROM dx INTERSECT SELECT pid FROM rx", "conditions", "fills"))
def _(z):
    return C.cohort_intersection(_dx(z), _rx(z))


@query(
    "j3_attach_demographics",
    with_frames(_DX + f" SELECT s.*, floor((coalesce(death, DATE '{AS_OF}') - birth) / 365.25)::INT AS age, (death IS NOT NULL)::INT AS deceased FROM subjects s JOIN dx USING (pid)", "conditions", "subjects"),
)
def _(z):
    return C.attach_demographics(_dx(z), z.subjects(), AS_OF)


@query(
    "j4_cohort_flow",
    with_frames(
        _DX + _RX + """ SELECT 'diagnosed' AS step, count(*) AS n FROM dx UNION ALL SELECT 'treated', count(*) FROM rx
        UNION ALL SELECT 'cohort', count(*) FROM (SELECT pid FROM dx INTERSECT SELECT pid FROM rx)""",
        "conditions", "fills",
    ),
)
def _(z):
    return C.cohort_flow(diagnosed=_dx(z), treated=_rx(z), cohort=C.cohort_intersection(_dx(z), _rx(z)))


@query("j5_incident_index_date", with_frames(_IDX + " SELECT * FROM idx", "fills"))
def _(z):
    return _idx(z)


@query("j6_baseline_eligible", with_frames(_IDX + _ELIG + " SELECT * FROM elig", "fills", "observations"))
def _(z):
    return C.baseline_eligible(_idx(z), z.observations(), "A")


@query(
    "j7_split_included_excluded",
    with_frames(
        _IDX + _ELIG + """ SELECT s.pid, index_date, (index_date IS NOT NULL AND s.pid IN (SELECT pid FROM elig))::INT AS included,
        CASE WHEN index_date IS NULL THEN 'no_fill' WHEN s.pid NOT IN (SELECT pid FROM elig) THEN 'no_baseline_obs' END AS reason FROM subjects s LEFT JOIN idx USING (pid)""",
        "fills", "observations", "subjects",
    ),
)
def _(z):
    idx = _idx(z)
    return C.split_included_excluded(z.subjects(), idx, C.baseline_eligible(idx, z.observations(), "A"))


@query("j8_pre_index_rows", with_frames(" SELECT o.*, index_date FROM observations o JOIN cohort USING (pid) WHERE date < index_date AND date >= index_date - 365", "observations", "cohort"))
def _(z):
    return C.pre_index_rows(z.observations(), z.cohort(), "date", 365)


_IV = """, iv AS (SELECT * FROM (SELECT pid, index_date AS ws, index_date + 180 AS we, greatest(start, index_date) AS cs,
    least(CASE WHEN stop > start THEN stop ELSE start + 30 END, index_date + 180) AS ce FROM fills JOIN cohort USING (pid)) WHERE cs < ce)"""
_SWEEP = """, reach AS (SELECT *, coalesce(max(ce) OVER (PARTITION BY pid ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ws) AS reach FROM iv),
    swept0 AS (SELECT pid, sum(greatest(ce - greatest(cs, reach), 0)) AS covered, greatest(max(greatest(cs - reach, 0)), min(we - ce)) AS gap FROM reach GROUP BY pid),
    swept AS (SELECT pid, coalesce(covered, 0)::BIGINT AS covered_days, coalesce(gap, 180)::INT AS max_gap FROM cohort LEFT JOIN swept0 USING (pid))"""


@query("j9_forward_window_intervals", with_frames(_IV + " SELECT * FROM iv", "fills", "cohort"))
def _(z):
    return C.forward_window_intervals(z.fills(), z.cohort())


def _swept(z):
    return V.sweep(C.forward_window_intervals(z.fills(), z.cohort()), z.cohort())


@query(
    "j10_latest_value",
    with_frames(
        """ SELECT pid, code, value AS latest FROM (SELECT o.*, row_number() OVER (PARTITION BY pid, code ORDER BY date DESC, value) AS n
        FROM observations o JOIN cohort USING (pid) WHERE date < index_date) WHERE n = 1""",
        "observations", "cohort",
    ),
)
def _(z):
    return C.latest_value(C.pre_index_rows(z.observations(), z.cohort(), "date"))


_A1 = ", pdc AS (SELECT pid, round(least(covered_days / 180.0, 1.0)::DOUBLE, 6) AS pdc_180d FROM swept)"
_A2 = ", gap AS (SELECT pid, max_gap, (max_gap >= 30)::INT AS has_30_day_gap FROM swept)"


@query("a1_pdc", with_frames(_IV + _SWEEP + _A1 + " SELECT * FROM pdc", "fills", "cohort"))
def pdc(z):
    return V.pdc(_swept(z))


@query("a2_gap_flag", with_frames(_IV + _SWEEP + _A2 + " SELECT * FROM gap", "fills", "cohort"))
def gaps(z):
    return V.gap_flag(_swept(z))


_BLOCKS = """, opened AS (SELECT *, CASE WHEN cs <= max(ce) OVER (PARTITION BY pid ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM iv),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY pid ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM opened),
    blocks AS (SELECT pid, min(cs) AS cs, max(ce) AS ce FROM numbered GROUP BY pid, block)"""


@query("w1_merge_intervals", with_frames(_IV + _BLOCKS + " SELECT * FROM blocks", "fills", "cohort"))
def _(z):
    return V.merge_intervals(C.forward_window_intervals(z.fills(), z.cohort()))


@query(
    "a3_prior_coverage",
    with_frames(
        """, iv AS (SELECT * FROM (SELECT pid, greatest(start, index_date - 365) AS cs, least(CASE WHEN stop > start THEN stop ELSE start + 30 END, index_date) AS ce
            FROM fills JOIN cohort USING (pid) WHERE start < index_date) WHERE cs < ce)""" + _BLOCKS + """,
        days AS (SELECT pid, sum(ce - cs) AS days FROM blocks GROUP BY pid), n AS (SELECT pid, count(*) AS n FROM iv GROUP BY pid)
        SELECT pid, round(least(coalesce(days, 0) / 365.0, 1.0)::DOUBLE, 6) AS adh_prior_med_pdc, coalesce(n, 0) AS adh_prior_n_med_fills FROM cohort LEFT JOIN days USING (pid) LEFT JOIN n USING (pid)""",
        "fills", "cohort",
    ),
)
def _(z):
    return V.prior_coverage(z.fills(), z.cohort())


# ---- features -----------------------------------------------------------------------------------


def _trajectory_sql(channels: dict[str, str], lookback: str) -> str:
    columns = ", ".join(
        f"""round(avg(value) FILTER (code = '{c}'), 6) AS {n}_mean, max(value) FILTER (code = '{c}') AS {n}_max, min(value) FILTER (code = '{c}') AS {n}_min,
        first(value ORDER BY date DESC, value) FILTER (code = '{c}') AS {n}_latest_reading, round(regr_slope(value, date - index_date) FILTER (code = '{c}'), 6) AS {n}_trajectory_slope"""
        for n, c in channels.items()
    )
    return f""", t AS (SELECT pid, {columns} FROM observations JOIN cohort USING (pid) WHERE date < index_date {lookback} AND code IN {_in(channels.values())} GROUP BY pid)"""


@query("a4_trajectory", with_frames(_trajectory_sql(CHANNELS, "AND date >= index_date - 1095") + " SELECT t.* REPLACE (c.pid AS pid) FROM cohort c LEFT JOIN t USING (pid)", "observations", "cohort"))
def trajectory(z):
    return X.trajectory(z.observations(), z.cohort(), CHANNELS)


@query("a5_ols_slope", "SELECT user_id, round(regr_slope(value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 86400000000), 6) AS slope FROM events GROUP BY user_id")
def _(z):
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-15")))) / F.lit(86_400_000_000)
    return z.table("events").groupBy("user_id").agg(F.round(X.ols_slope(F.col("value"), days), 6).alias("slope"))


@query(
    "a6_lab_trajectory",
    with_frames(
        _trajectory_sql({"lab_a1c": "A", "lab_ldl": "N"}, "") + """ SELECT c.pid, lab_a1c_latest_reading AS lab_a1c_latest, lab_a1c_trajectory_slope AS lab_a1c_slope,
        lab_ldl_latest_reading AS lab_ldl_latest, lab_ldl_trajectory_slope AS lab_ldl_slope FROM cohort c LEFT JOIN t USING (pid)""",
        "observations", "cohort",
    ),
)
def _(z):
    return X.lab_trajectory(z.observations(), z.cohort(), {"a1c": "A", "ldl": "N"})


def _counted(select: str, source: str, extra: str, out: str) -> str:
    return with_frames(f", f AS (SELECT pid, {select} FROM {source} JOIN cohort USING (pid) WHERE start < index_date {extra} GROUP BY pid) SELECT {out} FROM cohort LEFT JOIN f USING (pid)", source, "cohort")


@query("a7_comorbidity_count", _counted("count(DISTINCT code) AS n", "conditions", "", "pid, coalesce(n, 0) AS cmb_n_conditions"))
def comorbidity(z):
    return X.comorbidity_count(z.conditions(), z.cohort())


@query(
    "a8_regimen_counts",
    _counted(
        "count(DISTINCT CASE WHEN stop IS NULL OR stop > index_date THEN code END) AS a, count(DISTINCT CASE WHEN start >= index_date - 365 THEN code END) AS b",
        "fills", "", "pid, coalesce(a, 0) AS rx_n_active_meds, coalesce(b, 0) AS rx_n_meds_started_1y",
    ),
)
def regimen(z):
    return X.regimen_counts(z.fills(), z.cohort())


@query(
    "a9_engagement_counts",
    with_frames(
        """, v AS (SELECT pid, count(*) AS n FROM encounters JOIN cohort USING (pid) WHERE start < index_date AND start >= index_date - 365 GROUP BY pid),
        r AS (SELECT pid, count(*) AS n FROM observations JOIN cohort USING (pid) WHERE date < index_date AND date >= index_date - 1095 AND code = 'A' GROUP BY pid)
        SELECT c.pid, coalesce(v.n, 0) AS engage_n_encounters, coalesce(r.n, 0) AS engage_n_bp_readings FROM cohort c LEFT JOIN v USING (pid) LEFT JOIN r USING (pid)""",
        "encounters", "observations", "cohort",
    ),
)
def engagement(z):
    return X.engagement_counts(z.encounters(), z.observations().where("code = 'A'"), z.cohort())


@query(
    "a10_acute_utilization",
    _counted(
        "count(*) FILTER (start >= index_date - 365 AND class = 'emergency') AS e, count(*) FILTER (start >= index_date - 365 AND class = 'inpatient') AS i, count(*) FILTER (start >= index_date - 365 AND class = 'urgentcare') AS u, min(index_date - start) AS d",
        "encounters", "AND class <> 'ambulatory'", "pid, coalesce(e, 0) AS acute_n_ed_1y, coalesce(i, 0) AS acute_n_inpatient_1y, coalesce(u, 0) AS acute_n_urgentcare_1y, d::INT AS acute_days_since_last",
    ),
)
def _(z):
    return X.acute_utilization(z.encounters(), z.cohort())


@query(
    "a11_payer_switches",
    with_frames(
        """, s AS (SELECT p.*, index_date, lag(payer) OVER (PARTITION BY pid ORDER BY start, tie) AS before FROM payers p JOIN cohort USING (pid) WHERE start < index_date)
        , n AS (SELECT pid, sum(CASE WHEN before <> payer THEN 1 ELSE 0 END)::BIGINT AS n FROM s GROUP BY pid) SELECT pid, coalesce(n, 0) AS payer_n_switches FROM cohort LEFT JOIN n USING (pid)""",
        "payers", "cohort",
    ),
)
def switches(z):
    return X.payer_switches(z.payers(), z.cohort())


@query(
    "a12_cross_drug_profile",
    _counted(
        "count(DISTINCT code) AS a, max(index_date - start) AS b, min(index_date - start) AS c, count(DISTINCT encounter) AS d, round(avg(total - covered), 6) AS e",
        "fills", f"AND code NOT IN {_in(INDEX_CODES)}",
        "pid, coalesce(a, 0) AS xdrug_n_distinct_meds, coalesce(b, 0)::INT AS xdrug_tenure_days, c::INT AS xdrug_days_since_last_fill, coalesce(d, 0) AS xdrug_n_prescribers, e AS xdrug_oop_cost_mean",
    ),
)
def cross_drug(z):
    return X.cross_drug_profile(z.fills(), z.cohort(), INDEX_CODES)


@query(
    "a13_refill_gaps",
    with_frames(
        f""", s AS (SELECT pid, start - lag(start) OVER (PARTITION BY pid, code ORDER BY start) AS gap FROM fills JOIN cohort USING (pid) WHERE start < index_date AND code NOT IN {_in(INDEX_CODES)}),
        g AS (SELECT pid, round(avg(gap), 6) AS xdrug_refill_gap_mean, max(gap)::INT AS xdrug_refill_gap_max, round(stddev_samp(gap) / nullif(avg(gap), 0), 6) AS xdrug_refill_gap_cv FROM s WHERE gap IS NOT NULL GROUP BY pid)
        SELECT g.* REPLACE (c.pid AS pid) FROM cohort c LEFT JOIN g USING (pid)""",
        "fills", "cohort",
    ),
)
def refill(z):
    return X.refill_gaps(z.fills(), z.cohort(), INDEX_CODES)


_FLAGS = ", f AS (SELECT pid, " + ", ".join(f"max((code IN {_in(v)})::INT) AS flag_{k}" for k, v in GROUPS.items()) + " FROM conditions JOIN cohort USING (pid) WHERE start < index_date GROUP BY pid)"
_FLAG_COLUMNS = ", ".join(f"coalesce(flag_{k}, 0) AS flag_{k}" for k in GROUPS)


@query("a14_barrier_flags", with_frames(_FLAGS + f" SELECT pid, {_FLAG_COLUMNS} FROM cohort LEFT JOIN f USING (pid)", "conditions", "cohort"))
def flags(z):
    return X.barrier_flags(z.conditions(), z.cohort(), _groups(z), list(GROUPS))


@query(
    "a15_strict_flag",
    with_frames(
        f""", f AS (SELECT pid, (count(DISTINCT start) >= 2 AND max(start) >= max(index_date) - 365)::INT AS x FROM conditions JOIN cohort USING (pid)
        WHERE start < index_date AND code IN {_in(GROUPS["isolation"])} GROUP BY pid) SELECT pid, coalesce(x, 0) AS flag_isolation FROM cohort LEFT JOIN f USING (pid)""",
        "conditions", "cohort",
    ),
)
def _(z):
    return X.strict_flag(z.conditions(), z.cohort(), GROUPS["isolation"], "isolation")


@query(
    "a16_any_flag",
    with_frames(_FLAGS + f", g AS (SELECT pid, {_FLAG_COLUMNS} FROM cohort LEFT JOIN f USING (pid)) SELECT *, greatest(flag_isolation, flag_housing, flag_trauma) AS flag_sdoh_any FROM g", "conditions", "cohort"),
)
def _(z):
    return X.any_flag(flags(z))


@query(
    "a17_group_profile",
    with_frames(
        _IDX + _ELIG + f""", side AS (SELECT pid, CASE WHEN pid IN (SELECT pid FROM elig) THEN 'included' ELSE 'excluded' END AS side FROM subjects),
        k AS (SELECT pid, count(DISTINCT code) AS n, min(start) AS first_dx FROM conditions GROUP BY pid)
        SELECT side, count(*) AS n, round(avg(floor((coalesce(death, DATE '{AS_OF}') - birth) / 365.25)), 6) AS mean_age, round(avg(coalesce(k.n, 0)), 6) AS mean_conditions,
        round(avg((DATE '{AS_OF}' - first_dx) / 365.25), 6) AS mean_years_since_dx FROM side JOIN subjects USING (pid) LEFT JOIN k USING (pid) GROUP BY side""",
        "fills", "observations", "subjects", "conditions",
    ),
)
def _(z):
    idx = kept(_idx(z), "indexed")
    parts = kept(C.split_included_excluded(z.subjects(), idx, C.baseline_eligible(idx, z.observations(), "A")), "sides")
    return C.group_profile(parts.where("included = 1"), parts.where("included = 0"), z.subjects(), z.conditions(), AS_OF)


@query(
    "a18_survival_labels",
    with_frames(
        _IV + _SWEEP + _A1 + _A2 + " SELECT pid, has_30_day_gap AS event, round(CASE WHEN has_30_day_gap = 0 THEN 180.0 ELSE greatest(least(greatest(pdc_180d, 0), 1) * 180, 1) END::DOUBLE, 4) AS time FROM pdc JOIN gap USING (pid)",
        "fills", "cohort",
    ),
)
def _(z):
    swept = _swept(z)
    return X.survival_labels(V.pdc(swept).join(V.gap_flag(swept), "pid")).withColumn("time", F.round("time", 4))


_PANEL = (
    _IV + _SWEEP + _A1 + _A2
    + ", cmb AS (SELECT pid, count(DISTINCT code) AS n FROM conditions JOIN cohort USING (pid) WHERE start < index_date GROUP BY pid)"
    + ", rxa AS (SELECT pid, count(DISTINCT CASE WHEN stop IS NULL OR stop > index_date THEN code END) AS a, count(DISTINCT CASE WHEN start >= index_date - 365 THEN code END) AS b FROM fills JOIN cohort USING (pid) WHERE start < index_date GROUP BY pid)"
    + ", panel AS (SELECT c.pid, index_date, coalesce(cmb.n, 0) AS cmb_n_conditions, coalesce(a, 0) AS rx_n_active_meds, coalesce(b, 0) AS rx_n_meds_started_1y, pdc_180d FROM cohort c LEFT JOIN cmb USING (pid) LEFT JOIN rxa USING (pid) LEFT JOIN pdc USING (pid))"
)


def panel(z):
    # Stored, so that no task sorts the rows of several parts at once.
    features = [z.rows_by_subject(kept(part(z), "part")) for part in (comorbidity, regimen, pdc)]
    return C.assemble_panel(z.rows_by_subject(z.cohort()), features, {"cmb_n_conditions": 0, "rx_n_active_meds": 0, "rx_n_meds_started_1y": 0})


query("j11_assemble_panel", with_frames(_PANEL + " SELECT * FROM panel", "fills", "cohort", "conditions"))(panel)


@query("j12_labelled_frame", with_frames(_PANEL + " SELECT panel.*, max_gap, has_30_day_gap FROM panel JOIN gap USING (pid)", "fills", "cohort", "conditions"))
def labelled(z):
    return C.labelled_frame(panel(z), z.rows_by_subject(kept(gaps(z), "part")), "has_30_day_gap")


@query("j13_select_feature_columns", with_frames(_PANEL + " SELECT pid, cmb_n_conditions, rx_n_active_meds, rx_n_meds_started_1y FROM panel", "fills", "cohort", "conditions"))
def _(z):
    return C.select_feature_columns(labelled(z))


@query("j14_covered_subjects", with_frames(" SELECT pid, (pid IN (SELECT pid FROM feed))::INT AS covered FROM subjects", "subjects", "feed"))
def covered(z):
    return C.covered_subjects(z.subjects(), z.feed())
