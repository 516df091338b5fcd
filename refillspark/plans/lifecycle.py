"""Queries over sources, consent, escalation, closure and views, with the same results in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources as S
from ..operators import closure as K
from ..operators import cohort as C
from ..operators import consent as N
from ..operators import escalation as X
from ..operators import views as V
from .. import streaming as T
from . import features as base
from . import routing as R
from .lens import AS_OF, SQL as FRAMES, with_frames

Q: dict = {}
SQL: dict[str, str] = {}
START, TODAY = "2024-01-01", "2024-01-20"
ENTRY, TICK, LATENCY = "2000-10-01", AS_OF, 14


def query(name: str, sql: str | None = None):
    def add(f):
        base.query(name, sql)(f)
        Q[name] = base.Q.pop(name)
        if sql:
            SQL[name] = base.SQL.pop(name)
        return f

    return add


_PROFILES = f"profiles AS (SELECT * FROM {R._values(S.PROFILES, 'source, access_mode, min_latency, typical_latency, max_latency, requires_encounter, confirms_dispense, batch_permitted')})"
_PAID = f", {_PROFILES}, paid AS (SELECT * FROM feed WHERE lower(status) = 'paid' AND date BETWEEN DATE '{START}' AND DATE '{TODAY}' AND pid IN (SELECT pid FROM subjects))"
_EVENTS = _PAID + ", events1 AS (SELECT pid, date, coalesce(nullif(product, ''), 'unknown') AS product, try_cast(days_supply AS INT) AS days_supply, source, confirms_dispense AS is_dispense, typical_latency AS latency_days FROM paid, profiles WHERE source = 'claims')"
_FIRST = f", first_fill AS (SELECT pid, min(date) AS event_date FROM events1 WHERE is_dispense = 1 AND date BETWEEN DATE '{START}' AND DATE '{TODAY}' GROUP BY pid)"
_OUTCOMES = _EVENTS + _FIRST + f""", outcomes AS (SELECT pid, 1 AS observed, (event_date IS NOT NULL)::INT AS on_time_refill, coalesce(event_date, DATE '{TODAY}') AS event_date, 'claims' AS refill_source, 30 AS refill_latency_days
    FROM (SELECT pid FROM subjects WHERE pid IN (SELECT pid FROM feed)) LEFT JOIN first_fill USING (pid))"""


def _events(z):
    return S.dispense_events(S.read_claims_fills(z.feed(), z.subjects(), START, TODAY), S.source_profiles(z.spark), "claims")


def _outcomes(z):
    return K.refill_outcomes(z.subjects(), _events(z), base.covered(z), START, TODAY)


# ---- sources ------------------------------------------------------------------------------------


@query("s5_load_tables", "SELECT c_custkey AS pid, c_name, c_mktsegment FROM customer")
def _(z):
    return S.load_tables(z.spark, z.sf_dir, {"customer": ("pid", "c_name")}, {"c_custkey": "pid"})["customer"].select("pid", "c_name", "c_mktsegment")


@query("s6_code_groups", "SELECT 'group_' || p_size % 5 AS code_group, p_brand AS code, 'chw_call' AS action FROM part WHERE p_size % 5 < 3 GROUP BY ALL")
def _(z):
    dictionary = z.table("part").groupBy(F.concat(F.lit("group_"), F.col("p_size") % 5).alias("code_group")).agg(F.collect_set("p_brand").alias("codes"))
    dictionary = dictionary.withColumn("action", F.when(F.substring("code_group", -1, 1).cast("int") < 3, "chw_call"))
    return S.code_groups(dictionary)


@query("s7_read_claims_fills", with_frames(_PAID + " SELECT pid, date, event_id FROM paid", "feed", "subjects"))
def _(z):
    return S.read_claims_fills(z.feed(), z.subjects(), START, TODAY).select("pid", "date", "event_id")


@query("s8_dispense_events", with_frames(_EVENTS + " SELECT * FROM events1", "feed", "subjects"))
def _(z):
    return _events(z)


@query("s9_label_derived_events", with_frames(base._IV + base._SWEEP + base._A2 + f" SELECT pid, DATE '{AS_OF}' AS date, 'label' AS source FROM gap WHERE has_30_day_gap = 0", "fills", "cohort"))
def _(z):
    return S.label_derived_events(base.gaps(z), AS_OF)


_SOURCE_OF = "CASE stratum WHEN 'BUILDING' THEN 'claims' WHEN 'MACHINERY' THEN 'surescripts' ELSE 'rxfill' END"


@query(
    "s10_source_profiles",
    with_frames(
        f""", {_PROFILES}, late AS (SELECT s.pid, {_SOURCE_OF} AS source, event_id % 100 AS days FROM subjects s JOIN feed USING (pid))
        SELECT p.*, count(*) AS events, count(*) FILTER (days < min_latency) AS early, count(*) FILTER (days > max_latency) AS late FROM late JOIN profiles p USING (source) GROUP BY ALL""",
        "subjects", "feed",
    ),
)
def _(z):
    named = z.subjects().select("pid", F.expr(_SOURCE_OF).alias("source"))
    rows = named.join(z.feed().select("pid", (F.col("event_id") % 100).alias("days")), "pid")
    profiles = S.source_profiles(z.spark)
    rows = rows.join(F.broadcast(profiles), "source").groupBy(*profiles.columns)
    return rows.agg(F.count("*").alias("events"), F.count_if(F.expr("days < min_latency")).alias("early"), F.count_if(F.expr("days > max_latency")).alias("late"))


CHAIN = ["surescripts", "rxfill", "claims", "local_file"]
_TRACE = f""", {_PROFILES}, chain AS (SELECT * FROM {R._values(list(enumerate(CHAIN)), 'position, source')}),
    tried AS (SELECT s.pid, position, source, access_mode, batch_permitted, max_latency, CASE source WHEN 'surescripts' THEN region = 'ASIA' WHEN 'rxfill' THEN balance > 5000 WHEN 'claims' THEN s.pid IN (SELECT pid FROM feed) ELSE FALSE END AS reached
        FROM subjects s CROSS JOIN chain JOIN profiles USING (source)),
    firsts AS (SELECT *, min(position) FILTER (reached AND batch_permitted = 1) OVER (PARTITION BY pid) AS first FROM tried),
    trace AS (SELECT pid, position, source, access_mode, CASE WHEN position = first THEN 'served' WHEN reached THEN 'not_permitted' ELSE 'auth_failed' END AS outcome, CASE WHEN position = first THEN max_latency END AS max_latency
        FROM firsts WHERE first IS NULL OR position <= first)"""


def _trace(z):
    people = z.subjects()
    claims = z.feed().select("pid", F.lit("claims").alias("source")).distinct()
    reached = people.where("region = 'ASIA'").select("pid", F.lit("surescripts").alias("source")).union(people.where("balance > 5000").select("pid", F.lit("rxfill").alias("source"))).union(claims)
    return S.select_sources(people, S.source_profiles(z.spark), CHAIN, reached, batch=True)


@query("s11_select_source", with_frames(_TRACE + " SELECT pid, position, source, outcome, max_latency FROM trace", "subjects", "feed"))
def _(z):
    return _trace(z)


# ---- consent ------------------------------------------------------------------------------------

_STATUS = f""", cs0 AS (SELECT s.pid, coalesce(internal, 'unknown') AS internal, coalesce(external, 'unknown') AS external, (as_of IS NULL OR DATE '{TICK}' - as_of > 365)::INT AS stale FROM subjects s LEFT JOIN consent USING (pid)),
    cstat AS (SELECT *, (internal = 'granted' AND stale = 0)::INT AS internal_allowed, (external = 'granted' AND stale = 0)::INT AS external_allowed FROM cs0)"""


def _gate_sql(rows: str, out: str, keep: bool = False) -> str:
    kept = ", coalesce(internal_allowed, 0) AS internal_allowed, coalesce(external_allowed, 0) AS external_allowed" if keep else ""
    scope = "CASE action " + " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in N.SCOPES.items()) + " END"
    return f""", {out}0 AS (SELECT r.*, {scope} AS scope, internal, external, stale, internal_allowed, external_allowed FROM {rows} r LEFT JOIN cstat USING (pid)),
    {out} AS (SELECT * EXCLUDE (internal, external, stale, internal_allowed, external_allowed),
        CASE WHEN scope IS NULL THEN 0 WHEN scope = 'external' THEN external_allowed ELSE internal_allowed END AS allowed,
        CASE WHEN scope IS NULL THEN 'undeclared_action' WHEN st = 'denied' THEN 'denied' WHEN st = 'unknown' THEN 'unknown_not_received' WHEN stale = 1 THEN 'stale_consent' ELSE 'authorized' END AS reason{kept}
        FROM (SELECT *, CASE WHEN scope = 'external' THEN external ELSE internal END AS st FROM {out}0)) """.replace("EXCLUDE (internal,", "EXCLUDE (st, internal,")


def _status(z):
    return N.consent_status(z.subjects(), z.consent(), TICK)


@query("c1_consent_status", with_frames(_STATUS + " SELECT * FROM cstat", "subjects", "consent"))
def _(z):
    return _status(z)


_ACTIONS = ", acts AS (SELECT pid, ['transit_voucher', 'pharmacist', 'prescriber', 'smoke_signal'][1 + pid % 4] AS action FROM subjects)"


@query("c2_gate", with_frames(_STATUS + _ACTIONS + _gate_sql("acts", "g") + " SELECT * FROM g", "subjects", "consent"))
def _(z):
    names = F.array(*map(F.lit, ("transit_voucher", "pharmacist", "prescriber", "smoke_signal")))
    acts = z.subjects().select("pid", F.element_at(names, (F.col("pid") % 4 + 1).cast("int")).alias("action"))
    return N.gate(acts, _status(z))


@query("c3_stale_horizon", with_frames(" SELECT max(as_of) AS freshest, (DATE '2002-03-01' - max(as_of) > 365)::INT AS outlives_consent FROM consent", "consent"))
def _(z):
    return N.stale_horizon(z.consent(), "2002-03-01")


# ---- escalation ---------------------------------------------------------------------------------


def _schedule_sql(source: str, out: str) -> str:
    sql, before = f", {out}_b AS (SELECT *, entry_date + floor(greatest(days_to_break, 0))::INT AS break_date FROM {source})", "entry_date"
    name = f"{out}_b"
    for r, lead in enumerate(X.LEAD_DAYS):
        after = X.LEAD_DAYS[r + 1] if r < 2 else 0
        sql += f", {out}_{r}w AS (SELECT *, greatest(break_date - {lead}, entry_date, {before}) AS wait_{r} FROM {name})"
        sql += f", {out}_{r}e AS (SELECT *, greatest(break_date - {after}, wait_{r} + {X.DWELL_DAYS}) AS escalate_{r} FROM {out}_{r}w)"
        sql += f", {out}_{r} AS (SELECT *, escalate_{r} + {LATENCY} AS effective_{r} FROM {out}_{r}e)"
        name, before = f"{out}_{r}", f"effective_{r}"
    return sql + f", {out} AS (SELECT * REPLACE (CASE WHEN is_safety = 1 THEN entry_date ELSE wait_1 END AS wait_1), (days_to_break > 0 AND {LATENCY} >= days_to_break)::INT AS unactionable FROM {name})"


_ENTERED = f", entered AS (SELECT pid, driver, is_safety, days_to_break, DATE '{ENTRY}' + (pid % 60)::INT AS entry_date FROM worklist)"
_SCHED = R.WORKLIST_SQL + _ENTERED + _schedule_sql("entered", "sched")
_ROUND = "CASE WHEN is_safety = 1 THEN CASE WHEN ref >= effective_1 THEN 2 ELSE 1 END WHEN ref >= effective_0 AND ref >= effective_1 THEN 2 WHEN ref >= effective_0 THEN 1 ELSE 0 END"
_FIRST_ACTION = "CASE WHEN is_safety = 1 THEN 'social_worker' ELSE CASE driver " + " ".join(f"WHEN '{d}' THEN '{a}'" for d, a in X.ROUND1.items()) + f" ELSE '{X.ROUND1_DEFAULT}' END END"
_ACTION = f"CASE round WHEN 0 THEN 'chw_pharmacy' WHEN 1 THEN {_FIRST_ACTION} ELSE 'prescriber' END"
_PICK = lambda p: f"CASE round WHEN 0 THEN {p}_0 WHEN 1 THEN {p}_1 ELSE {p}_2 END"
#: Days from the events' calendar to that of the cards.
SHIFT = (dt.date.fromisoformat(START) - dt.date(2000, 12, 5)).days
_SEEN = _OUTCOMES + f", seen AS (SELECT pid, observed, on_time_refill, event_date - {SHIFT} AS event_date FROM outcomes)"


def _state_sql(day: str) -> str:
    """``states`` as of a day, of the frames ``sched``, ``seen`` and ``cstat``."""
    return (
        f", st0 AS (SELECT s.*, observed, on_time_refill, event_date, CASE WHEN observed = 1 THEN coalesce(event_date, DATE '{day}') ELSE DATE '{day}' END AS ref FROM sched s LEFT JOIN seen USING (pid))"
        + f", st1 AS (SELECT *, ({_ROUND})::INT AS round FROM st0), st2 AS (SELECT *, {_ACTION} AS action FROM st1)"
        + _gate_sql("st2", "st3", keep=True)
        + f", st4 AS (SELECT *, {_PICK('wait')} AS wait_until, {_PICK('escalate')} AS escalate_at, {_PICK('effective')} AS effective_escalate_at FROM st3)"
        + f""", states AS (SELECT *, CASE WHEN observed = 1 AND on_time_refill = 1 THEN 'CLOSED' WHEN observed = 1 THEN 'EXHAUSTED' WHEN round = 2 AND DATE '{day}' >= effective_escalate_at THEN 'EXHAUSTED'
        WHEN DATE '{day}' < wait_until THEN 'WAITING' WHEN allowed = 0 AND scope = 'internal' THEN 'GATED_ON_CONSENT'
        WHEN DATE '{day}' >= escalate_at AND DATE '{day}' < effective_escalate_at THEN 'WAITING_ON_DATA_LATENCY' ELSE 'PENDING' END AS status,
        ((is_safety = 0 AND internal_allowed = 0) OR (round >= 1 AND CASE WHEN is_safety = 0 AND driver IN ('transport', 'access') THEN external_allowed ELSE internal_allowed END = 0) OR (round = 2 AND internal_allowed = 0))::INT AS any_gated FROM st4)"""
    )


_STATE = _SCHED + _SEEN + _STATUS + _state_sql(TICK)
_STATE_FRAMES = (*R.WORKLIST_FRAMES, "subjects", "consent", "feed")


def _entered(z, cards=None):
    return (R.worklist(z) if cards is None else cards).select("pid", "driver", "is_safety", "days_to_break", F.date_add(F.to_date(F.lit(ENTRY)), (F.col("pid") % 60).cast("int")).alias("entry_date"))


def _seen(z):
    return _outcomes(z).withColumn("event_date", F.date_sub("event_date", SHIFT))


def _scheduled(z, cards=None):
    return X.round_schedule(_entered(z, cards), LATENCY)


def _states(z, cards=None):
    cards = T.kept(R.worklist(z), "cards") if cards is None else cards
    return X.escalation_status(_scheduled(z, cards), _seen(z), _status(z), TICK)


def _rounds(z, cards=None):
    return X.round_rows(_states(z, cards), _status(z))


_BOUNDARIES = [f"{p}_{r}" for r in range(3) for p in ("wait", "escalate", "effective")]


@query("c4_round_schedule", with_frames(_SCHED + f" SELECT pid, break_date, {', '.join(_BOUNDARIES)}, unactionable FROM sched", *R.WORKLIST_FRAMES))
def _(z):
    return _scheduled(z).select("pid", "break_date", *_BOUNDARIES, "unactionable")


@query("c5_current_round", with_frames(_STATE + " SELECT pid, ref, round FROM states", *_STATE_FRAMES))
def _(z):
    return _states(z).select("pid", "ref", "round")


@query("c6_round_action", with_frames(_STATE + " SELECT pid, round, action, scope FROM states", *_STATE_FRAMES))
def _(z):
    return _states(z).select("pid", "round", "action", "scope")


@query("c7_escalation_status", with_frames(_STATE + " SELECT pid, round, status, CASE WHEN status = 'CLOSED' THEN round END AS closed_on_round, reason, wait_until, effective_escalate_at FROM states", *_STATE_FRAMES))
def _(z):
    return _states(z).select("pid", "round", "status", "closed_on_round", "reason", "wait_until", "effective_escalate_at")


_ROUNDS = (
    _STATE + ", rr0 AS (SELECT * EXCLUDE (round, action, scope, allowed, reason, wait_until, escalate_at, effective_escalate_at, internal_allowed, external_allowed), round AS current, unnest(range(CASE WHEN is_safety = 1 THEN 1 ELSE 0 END, round + 1))::INT AS round FROM states)"
    + f", rr1 AS (SELECT *, {_ACTION} AS action FROM rr0)" + _gate_sql("rr1", "rr2")
    + f""", rr3 AS (SELECT *, {_PICK('wait')} AS wait_until, {_PICK('escalate')} AS escalate_at, {_PICK('effective')} AS effective_escalate_at, (allowed = 0)::INT AS gated, allowed = 0 AND scope <> 'external' AS hard FROM rr2),
    rounds AS (SELECT pid, round, action, scope, wait_until, escalate_at, effective_escalate_at, gated, CASE WHEN gated = 1 THEN reason END AS consent_reason, CASE WHEN gated = 1 AND scope = 'external' THEN 'chw_transport_support' END AS fallback_action,
        CASE WHEN round < current THEN CASE WHEN hard THEN 'gated_internal' ELSE 'no_refill' END WHEN status = 'CLOSED' THEN 'refill_observed' WHEN status = 'GATED_ON_CONSENT' THEN 'gated' WHEN status = 'EXHAUSTED' THEN 'no_refill' ELSE 'pending' END AS outcome,
        CASE WHEN NOT hard AND (round < current OR (ref >= wait_until AND status NOT IN ('WAITING', 'PENDING'))) THEN wait_until END AS dispatched_on, driver, break_date FROM rr3)"""
)


@query("c8_round_rows", with_frames(_ROUNDS + " SELECT * FROM rounds", *_STATE_FRAMES))
def _(z):
    return _rounds(z)


_PARTS = ["round", "action", "outcome", "dispatched_on", "gated", "consent_reason", "fallback_action", "wait_until", "escalate_at", "effective_escalate_at"]


@query("c8_round_history", with_frames(_ROUNDS + f" SELECT pid, count(*)::INT AS n, string_agg({' || chr(58) || '.join(f'coalesce({c}::VARCHAR, chr(45))' for c in _PARTS)}, ';' ORDER BY round) AS said FROM rounds GROUP BY pid", *_STATE_FRAMES))
def _(z):
    history = X.round_history(_rounds(z))
    text = lambda r: F.concat_ws(":", *(F.coalesce(r[c].cast("string"), F.lit("-")) for c in _PARTS))
    return history.select("pid", F.size("rounds").alias("n"), F.array_join(F.transform("rounds", text), ";").alias("said"))


@query("c9_gated_actions", with_frames(_ROUNDS + " SELECT pid, round, action, scope, consent_reason AS reason, fallback_action FROM rounds WHERE gated = 1", *_STATE_FRAMES))
def _(z):
    return X.gated_actions(_rounds(z))


#: Written from the rules of dispatch, not from the operator's table.
_SENT = _ROUNDS + """, told AS (SELECT *, CASE WHEN round = 0 OR fallback_action IS NOT NULL THEN 'ae_chw' WHEN action = 'transit_voucher' THEN 'transit_voucher_external' ELSE action END AS recipient,
    CASE WHEN fallback_action IS NOT NULL THEN 'chw_transport_fallback' ELSE action END AS kind,
    CASE WHEN round = 0 THEN 'pharmacy' WHEN fallback_action IS NOT NULL THEN 'internal_transportation' WHEN action = 'transit_voucher' THEN 'transit_broker' END AS mediated_by FROM rounds)"""


@query("c10_dispatch_recipient", with_frames(_SENT + " SELECT pid, round, recipient, kind, mediated_by FROM told", *_STATE_FRAMES))
def _(z):
    return X.dispatch_recipient(_rounds(z))


def _in_languages(select) -> str:
    return " UNION ALL ".join(select(lang) for lang in X.MESSAGES)


def _word(column: str, labels: dict, lang: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {R.said(v[lang], {})}" for k, v in labels.items()) + " END"


def _line(lang: str) -> str:
    who, how = _word("p.recipient", X.RECIPIENT_LABELS, lang), _word("p.outcome", X.OUTCOME_WORDS, lang)
    return f"'{X.ROUND_WORDS[lang]} ' || p.round || ' (' || {who} || ') - ' || coalesce(p.dispatched_on::VARCHAR, '-') || ' - ' || {how}"


_HISTORY = _SENT + ", hist AS (" + _in_languages(
    lambda lang: f"SELECT r.pid, r.round, '{lang}' AS lang, coalesce(string_agg({_line(lang)}, '; ' ORDER BY p.round) FILTER (p.round IS NOT NULL), {R.said(X.NO_HISTORY[lang], {})}) AS history FROM told r LEFT JOIN told p ON r.pid = p.pid AND p.round < r.round GROUP BY r.pid, r.round"
) + ")"


def _message(lang: str) -> str:
    who = _word("recipient", X.RECIPIENT_LABELS, lang)
    fields = {
        "who": who, "request": _word("kind", X.REQUESTS, lang), "ref": "'Patient #' || substring(pid::VARCHAR, 1, 8)", "round": "round", "break_date": "break_date", "history": "history",
        "driver": R.labelled_sql("told.driver", R.R.DRIVER_LABELS, lang), "days": "floor(days_to_break)::INT", "risk": "round(100 * risk)::INT", "rank": "rank_in_role", "source": "'claims'",
    }
    return f"""SELECT pid, round, lang, recipient, {who} AS recipient_label, kind, mediated_by, 'provider_or_organization' AS addressed_to, floor(days_to_break)::INT AS days, round(100 * risk)::INT AS risk_pct, rank_in_role, 'claims' AS refill_source,
        {R.said(X.MESSAGES[lang], fields)} AS body, CASE WHEN recipient IN ('ae_chw', 'bilingual_chw', 'prescriber') THEN {R.said(X.READ_ALOUD[lang], {})} END AS read_aloud
        FROM told JOIN hist USING (pid, round) JOIN (SELECT pid, days_to_break, risk, rank_in_role FROM worklist) USING (pid) WHERE lang = '{lang}' AND dispatched_on IS NOT NULL"""


_MESSAGES = _HISTORY + ", messages AS (" + _in_languages(_message) + ")"


@query("c11_dispatch_messages", with_frames(_MESSAGES + " SELECT * FROM messages", *_STATE_FRAMES))
def _(z):
    cards = T.kept(R.worklist(z), "cards")
    return X.dispatch_messages(_rounds(z, cards), cards, "claims")


@query("c12_intervention_history", with_frames(_HISTORY + " SELECT * FROM hist", *_STATE_FRAMES))
def _(z):
    return X.intervention_history(_rounds(z))


def _tick(z):
    cards = T.kept(R.worklist(z), "cards")
    first = X.advance_state(cards, _seen(z).limit(0), _status(z), None, ENTRY, LATENCY)
    return X.advance_state(cards, _seen(z), _status(z), first, TICK, LATENCY)


# The first tick dispatches, on the day of entry, the round that acts at once and that consent allows.
_AT_ONCE = f"CASE WHEN internal_allowed = 0 THEN NULL WHEN is_safety = 1 THEN 1 WHEN wait_0 <= DATE '{ENTRY}' THEN 0 END"
_ADVANCED = (
    _STATE.replace(f"DATE '{ENTRY}' + (pid % 60)::INT AS entry_date", f"DATE '{ENTRY}' AS entry_date").replace("ELSE 'PENDING' END AS status", f"WHEN round = {_AT_ONCE} THEN 'DISPATCHED' ELSE 'PENDING' END AS status")
    + f""", rounds3 AS (SELECT *, unnest([0, 1, 2]) AS r FROM states), sent AS (SELECT pid, r, CASE WHEN r = round AND status = 'PENDING' THEN DATE '{TICK}' ELSE {_PICK('wait').replace('CASE round', 'CASE r')} END AS day FROM rounds3
        WHERE r <= round AND r >= is_safety AND (internal_allowed = 1 OR (r = 1 AND is_safety = 0 AND driver IN ('transport', 'access')))
        AND (r < round OR status = 'PENDING' OR (status <> 'WAITING' AND ref >= {_PICK('wait').replace('CASE round', 'CASE r')})))"""
)


@query(
    "c13_advance_state",
    with_frames(
        _ADVANCED + f""" SELECT pid, entry_date, days_to_break, round, CASE WHEN status = 'PENDING' THEN 'DISPATCHED' ELSE status END AS status, wait_until, escalate_at, effective_escalate_at,
        CASE WHEN status = 'CLOSED' THEN round END AS closed_on_round, any_gated, DATE '{TICK}' AS as_of,
        coalesce((SELECT string_agg(r || ':' || day, ',' ORDER BY r) FROM sent WHERE sent.pid = states.pid), '') AS sent FROM states""",
        *_STATE_FRAMES,
    ),
)
def _(z):
    dates = F.array_sort(F.transform(F.map_entries("dispatch_dates"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))))
    kept = ["pid", "entry_date", "days_to_break", "round", "status", "wait_until", "escalate_at", "effective_escalate_at", "closed_on_round", "any_gated", "as_of"]
    return _tick(z).select(*kept, F.array_join(dates, ",").alias("sent"))


@query(
    "c14_escalation_funnel",
    with_frames(
        _STATE + """, f AS (SELECT 'total' AS measure, 'all' AS key FROM states UNION ALL SELECT 'status', status FROM states UNION ALL SELECT 'round', round::VARCHAR FROM states
        UNION ALL SELECT 'closed_on_round', round::VARCHAR FROM states WHERE status = 'CLOSED' UNION ALL SELECT 'gated', 'all' FROM states WHERE any_gated = 1 UNION ALL SELECT 'unactionable', 'all' FROM states WHERE unactionable = 1) SELECT measure, key, count(*) AS n FROM f GROUP BY ALL""",
        *_STATE_FRAMES,
    ),
)
def _(z):
    return X.escalation_funnel(_states(z))


@query("c15_active_latency", with_frames(_TRACE + " SELECT s.pid, coalesce(source, 'unknown') AS source, coalesce(t.max_latency, 0) AS latency FROM subjects s LEFT JOIN (SELECT * FROM trace WHERE outcome = 'served') t USING (pid)", "subjects", "feed"))
def _(z):
    return X.active_latencies(z.subjects(), _trace(z))


# ---- closure ------------------------------------------------------------------------------------


@query("t1_first_dispense", with_frames(_EVENTS + _FIRST + " SELECT * FROM first_fill", "feed", "subjects"))
def _(z):
    return K.first_dispense(_events(z), START, TODAY)


@query("t2_refill_outcomes", with_frames(_OUTCOMES + " SELECT * FROM outcomes", "feed", "subjects"))
def _(z):
    return _outcomes(z)


@query("t3_closure_summary", with_frames(_OUTCOMES + " SELECT (SELECT count(*) FROM subjects) AS n_routed, count(*) AS n_observed, count(*) FILTER (on_time_refill = 1) AS n_on_time, count(*) FILTER (on_time_refill = 0) AS n_break FROM outcomes", "feed", "subjects"))
def _(z):
    return K.closure_summary(z.subjects(), _outcomes(z))


_ACTIONED = R.WORKLIST_SQL + _OUTCOMES + ", labels AS (SELECT pid, on_time_refill AS adherent FROM outcomes WHERE pid IN (SELECT pid FROM worklist WHERE included = 1))"


def _labels(z):
    return K.harvest_labels(_outcomes(z), R.worklist(z).where("included = 1"))


@query("t4_harvest_labels", with_frames(_ACTIONED + " SELECT * FROM labels", *R.WORKLIST_FRAMES, "feed", "subjects"))
def _(z):
    return _labels(z).select("pid", "adherent")


@query("j15_overlay_labels", with_frames(base._IV + base._SWEEP + base._A2 + _ACTIONED + " SELECT pid, coalesce(1 - adherent, has_30_day_gap)::INT AS has_30_day_gap FROM gap LEFT JOIN labels USING (pid)", "fills", "cohort", *R.WORKLIST_FRAMES, "feed", "subjects"))
def _(z):
    return C.overlay_labels(base.gaps(z), _labels(z))


# ---- views --------------------------------------------------------------------------------------

_UNTIL = f""", timed AS (SELECT *, CASE WHEN status = 'WAITING' THEN wait_until WHEN status = 'WAITING_ON_DATA_LATENCY' THEN effective_escalate_at WHEN status NOT IN ('CLOSED', 'EXHAUSTED') THEN escalate_at END - DATE '{TICK}' AS days_remaining,
    CASE WHEN status = 'WAITING_ON_DATA_LATENCY' THEN effective_escalate_at - DATE '{TICK}' END AS days_until_latency_clears FROM states)"""
_LANGS = list(X.MESSAGES)
_SAID = ", ".join(f"max(body) FILTER (lang = '{lang}') AS b_{lang}, max(read_aloud) FILTER (lang = '{lang}') AS a_{lang}" for lang in _LANGS)
_TEXTS = ", ".join(
    f"coalesce(b_{lang}, {R.rationale_sql(lang, 'w.')}) AS message_{lang}, a_{lang} AS read_aloud_{lang}, {R.labelled_sql('w.driver', R.R.DRIVER_LABELS, lang)} AS driver_{lang}, {R.labelled_sql('w.action', R.R.ACTION_LABELS, lang)} AS action_{lang}"
    for lang in _LANGS
)
_ROUND_LABELS = ", ".join(f"'{word} ' || round AS round_{lang}" for lang, word in X.ROUND_WORDS.items())
_BLOCK = """, block AS (SELECT t.pid, string_agg(t.round || ':' || t.action || ':' || coalesce(t.consent_reason, '-') || ':' || coalesce(t.fallback_action, '-'), ';' ORDER BY t.round) FILTER (t.gated = 1) AS gated_actions,
    string_agg(t.round || ':' || recipient || ':' || coalesce(mediated_by, '-') || ':' || coalesce(dispatched_on::VARCHAR, '-') || ':' || outcome, ';' ORDER BY t.round) AS dispatch_history,
    max(recipient || ':' || kind || ':' || coalesce(mediated_by, '-')) FILTER (t.round = s.round AND dispatched_on IS NOT NULL) AS current_dispatch FROM told t JOIN states s ON t.pid = s.pid GROUP BY t.pid)"""
_VIEW = _MESSAGES + _UNTIL + _BLOCK + f""", now AS (SELECT m.pid, {_SAID} FROM messages m JOIN states s ON m.pid = s.pid AND m.round = s.round GROUP BY m.pid),
    viewed AS (SELECT w.pid, 'Patient #' || substring(w.pid::VARCHAR, 1, 8) AS name, 'en' AS preferred_language, DATE '{TICK}' + floor(greatest(w.days_to_break - 3, 0))::INT AS window_start, DATE '{TICK}' + floor(w.days_to_break + 3)::INT AS window_end,
    risk, w.driver, w.action, score, w.needs_review AS requires_review, w.is_safety, {_TEXTS}, seen.on_time_refill, status, round, days_remaining, days_until_latency_clears, break_date, unactionable, any_gated,
    {_ROUND_LABELS}, internal || '/' || external || '/' || stale || '/' || cstat.internal_allowed || '/' || cstat.external_allowed AS consent, coalesce(gated_actions, '') AS gated_actions, dispatch_history, current_dispatch
    FROM worklist w LEFT JOIN timed USING (pid) LEFT JOIN now USING (pid) LEFT JOIN seen USING (pid) LEFT JOIN cstat USING (pid) LEFT JOIN block USING (pid) WHERE included = 1)"""


def _nested(z):
    cards = T.kept(R.worklist(z), "cards")
    states = T.kept(_states(z, cards), "states")
    rounds = T.kept(X.round_rows(states, _status(z)), "rounds")
    return V.worklist_view(cards, states, TICK, X.dispatch_messages(rounds, cards, "claims"), _seen(z), rounds, _status(z))


def _flat(view):
    """The nested parts as columns, for comparison."""
    texts = [F.col(c)[lang].alias(f"{name}_{lang}") for lang in _LANGS for c, name in (("message", "message"), ("read_aloud", "read_aloud"), ("driver_label", "driver"), ("action_label", "action"), ("escalation.round_label", "round"))]
    line = lambda r, *names: F.concat_ws(":", *(F.coalesce(r[c].cast("string"), F.lit("-")) for c in names))
    of = lambda c: F.col(f"escalation.{c}")
    blocks = [
        F.concat_ws("/", *(of(f"consent.{c}") for c in ("internal", "external", "stale", "internal_allowed", "external_allowed"))).alias("consent"),
        F.array_join(F.transform(of("gated_actions"), lambda r: line(r, "round", "action", "consent_reason", "fallback_action")), ";").alias("gated_actions"),
        F.array_join(F.transform(of("dispatch_history"), lambda r: line(r, "round", "recipient", "mediated_by", "dispatched_on", "outcome")), ";").alias("dispatch_history"),
        F.when(of("current_dispatch").isNotNull(), line(of("current_dispatch"), "recipient", "kind", "mediated_by")).alias("current_dispatch"),
    ]
    plain = [of(c).alias(c) for c in ("status", "round", "days_remaining", "days_until_latency_clears", "break_date", "unactionable", "any_gated")]
    return view.select("pid", "name", "preferred_language", "window_start", "window_end", "risk", "driver", "action", "score", "requires_review", "is_safety", *texts, "on_time_refill", *plain, *blocks)


@query("v1_worklist_view", with_frames(_VIEW + " SELECT * FROM viewed", *_STATE_FRAMES))
def _view(z):
    return _flat(_nested(z))


@query("v2_escalation_countdown", with_frames(_STATE + _UNTIL + " SELECT pid, status, days_remaining, days_until_latency_clears FROM timed", *_STATE_FRAMES))
def _(z):
    return V.escalation_countdown(_states(z), TICK)


@query("v3_subject_lookup", with_frames(_VIEW + " SELECT * FROM viewed WHERE pid = (SELECT min(pid) FROM viewed)", *_STATE_FRAMES))
def _(z):
    view = _view(z)
    return view.join(F.broadcast(view.agg(F.min("pid").alias("pid"))), "pid", "left_semi")


@query(
    "v4_source_status",
    with_frames(
        _TRACE + """, each AS (SELECT pid, string_agg(source || ':' || outcome, ';' ORDER BY position) AS trace, max(source) FILTER (outcome = 'served') AS source FROM trace GROUP BY pid)
        SELECT e.source, p.access_mode, min_latency, typical_latency, max_latency, e.trace, count(*) AS subjects FROM each e LEFT JOIN profiles p ON e.source = p.source GROUP BY ALL""",
        "subjects", "feed",
    ),
)
def _(z):
    return V.source_status(_trace(z), S.source_profiles(z.spark))


@query(
    "v5_worklist_kpis",
    with_frames(
        R.WORKLIST_SQL + _SEEN + """, r AS (SELECT action, count(*) AS n, count(*) FILTER (is_safety = 1 OR needs_review = 1) AS s, count(*) FILTER (on_time_refill = 1) AS t, count(*) FILTER (on_time_refill = 0) AS b, max(risk) AS r FROM worklist LEFT JOIN seen USING (pid) WHERE included = 1 GROUP BY action)
        SELECT sum(n)::BIGINT AS routed, sum(s)::BIGINT AS safety, sum(t)::BIGINT AS on_time, sum(b)::BIGINT AS breaks, round(100 * max(r), 4) AS peak_risk_pct, sum(n - t)::BIGINT AS open_loops,
        coalesce(sum(n) FILTER (action = 'pharmacist'), 0)::BIGINT AS n_pharmacist, coalesce(sum(n) FILTER (action = 'social_worker'), 0)::BIGINT AS n_social_worker, coalesce(sum(n) FILTER (action = 'chw_call'), 0)::BIGINT AS n_chw_call,
        (SELECT action FROM r ORDER BY n DESC, action DESC LIMIT 1) AS dominant_route, round(100 * max(n) / sum(n), 4) AS dominant_route_pct FROM r""",
        *R.WORKLIST_FRAMES, "subjects", "feed",
    ),
)
def _(z):
    return V.worklist_kpis(R.worklist(z), _seen(z))


@query(
    "v6_cascade_counts",
    with_frames(
        _STATE + """, c AS (SELECT round, count(*) AS total, count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'EXHAUSTED') AS exhausted, count(*) FILTER (any_gated = 1 OR status = 'GATED_ON_CONSENT') AS gated FROM states GROUP BY round)
        SELECT k AS round, coalesce(total, 0) AS total, coalesce(closed, 0) AS closed, coalesce(exhausted, 0) AS exhausted, coalesce(gated, 0) AS gated, coalesce(total - closed - exhausted, 0) AS in_flight FROM (VALUES (0), (1), (2)) v(k) LEFT JOIN c ON k = round""",
        *_STATE_FRAMES,
    ),
)
def _(z):
    return V.cascade_counts(_states(z))


@query("v7_worklist_filter", with_frames(_VIEW + " SELECT * FROM viewed WHERE contains(lower(concat_ws(' ', name, pid, driver, action)), 'safety') AND risk >= 0.05 AND action = 'social_worker'", *_STATE_FRAMES))
def _(z):
    return V.worklist_filter(_view(z), "safety", "social_worker", 0.05, "risk")


# The texts of labels are searched in all languages, and the least urgent come first.
@query(
    "v7_worklist_facets",
    with_frames(
        _VIEW + f""", hits AS (SELECT * FROM viewed WHERE contains(lower(concat_ws(' ', name, pid, driver, action, {', '.join(f'driver_{lang}, action_{lang}' for lang in _LANGS)})), 'contacto') AND status = 'CLOSED')
        SELECT pid, status, round, risk, row_number() OVER (ORDER BY risk, pid)::INT AS place FROM hits WHERE round = 1""",
        *_STATE_FRAMES,
    ),
)
def _(z):
    found = V.worklist_filter(_nested(z), "Contacto", sort="risk", status="CLOSED", round_number=1, descending=False)
    page = found.select("pid", "escalation.status", "escalation.round", "risk")
    return page.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("risk", "pid")))  # the cards that the caps take

@query("v8_urgency_index", with_frames(R.WORKLIST_SQL + " SELECT pid, greatest(1, round(100 * score / (SELECT max(score) FROM worklist))::INT) AS urgency FROM worklist", *R.WORKLIST_FRAMES))
def _(z):
    return V.urgency_index(R.worklist(z))
