"""Escalation: three rounds anchored to a predicted break, held back by consent and by source latency.

All of it is column logic over one row a subject; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consent import FALLBACK, gate, scope_of

LEAD_DAYS = (60, 30, 10)
DWELL_DAYS = 7
ROUND1 = {"transport": "transit_voucher", "access": "transit_voucher", "cost": "pharmacist", "bp_trend": "pharmacist", "isolation": "social_worker"}
ROUND1_DEFAULT = "social_worker"
#: Of each action: who is written to, the kind of message, and whom the recipient contacts for the subject (fixed values).
DISPATCH = {
    "chw_pharmacy": ("ae_chw", "chw_pharmacy", "pharmacy"),
    "social_worker": ("social_worker", "social_worker", None),
    "pharmacist": ("pharmacist", "pharmacist", None),
    "bilingual_chw": ("bilingual_chw", "bilingual_chw", None),
    "transit_voucher": ("transit_voucher_external", "transit_voucher", "transit_broker"),
    "chw_transport_support": ("ae_chw", "chw_transport_fallback", "internal_transportation"),
    "prescriber": ("prescriber", "prescriber", None),
}
#: Recipients who speak with the subject and get a script to read aloud (fixed values).
READERS = ("ae_chw", "bilingual_chw", "prescriber")
RECIPIENT_LABELS = {
    "ae_chw": {"en": "community health worker", "es": "agente comunitario", "pt": "agente comunitário", "ht": "ajan kominotè"},
    "bilingual_chw": {"en": "bilingual health worker", "es": "agente bilingüe", "pt": "agente bilingue", "ht": "ajan bileng"},
    "social_worker": {"en": "social worker", "es": "trabajo social", "pt": "assistente social", "ht": "travayè sosyal"},
    "pharmacist": {"en": "pharmacist", "es": "farmacia", "pt": "farmacêutico", "ht": "famasyen"},
    "transit_voucher_external": {"en": "transport provider", "es": "servicio de transporte", "pt": "serviço de transporte", "ht": "sèvis transpò"},
    "prescriber": {"en": "prescriber", "es": "quien prescribe", "pt": "prescritor", "ht": "preskriptè"},
}
OUTCOME_WORDS = {
    "pending": {"en": "under way", "es": "en marcha", "pt": "em andamento", "ht": "ap fèt"},
    "no_refill": {"en": "no refill seen", "es": "sin recarga", "pt": "sem recarga", "ht": "pa gen rechaj"},
    "refill_observed": {"en": "refill seen", "es": "con recarga", "pt": "com recarga", "ht": "gen rechaj"},
    "gated": {"en": "held by consent", "es": "retenida por consentimiento", "pt": "retida por consentimento", "ht": "konsantman bloke"},
    "gated_internal": {"en": "not sent, no consent", "es": "no enviada, sin consentimiento", "pt": "não enviada, sem consentimento", "ht": "pa voye, san konsantman"},
}
ROUND_WORDS = {"en": "Round", "es": "Ronda", "pt": "Ronda", "ht": "Faz"}
NO_HISTORY = {"en": "nothing recorded", "es": "nada registrado", "pt": "nada registado", "ht": "anyen anrejistre"}
REQUESTS = {
    "chw_pharmacy": {"en": "ask the pharmacy about the refill", "es": "consulte la recarga en la farmacia", "pt": "pergunte à farmácia pela recarga", "ht": "mande famasi a pou rechaj la"},
    "social_worker": {"en": "find out what stands in the way", "es": "averigüe qué lo impide", "pt": "veja o que o impede", "ht": "chèche sa ki bloke l"},
    "pharmacist": {"en": "review the medicine and its cost", "es": "revise el medicamento y su costo", "pt": "reveja o medicamento e o custo", "ht": "revize medikaman an ak pri a"},
    "bilingual_chw": {"en": "call in the preferred language", "es": "llame en el idioma preferido", "pt": "ligue na língua preferida", "ht": "rele nan lang li pito"},
    "transit_voucher": {"en": "issue a travel voucher", "es": "emita un vale de transporte", "pt": "emita um vale de transporte", "ht": "bay yon bon transpò"},
    "chw_transport_fallback": {"en": "arrange transport within the organisation", "es": "organice transporte interno", "pt": "organize transporte interno", "ht": "òganize transpò entèn"},
    "prescriber": {"en": "decide on the next step with the history below", "es": "decida el próximo paso con el historial", "pt": "decida o próximo passo com o histórico", "ht": "deside pwochen etap la ak istwa a"},
}
MESSAGES = {
    "en": "To the {who}: {request} for {ref}, round {round}, before {break_date} ({days} days, risk {risk} %, place {rank}; driver: {driver}; refills by {source}). Tried before: {history}.",
    "es": "Para {who}: {request}, {ref}, ronda {round}, antes del {break_date} ({days} días, riesgo {risk} %, puesto {rank}; factor: {driver}; recargas según {source}). Intentos previos: {history}.",
    "pt": "Para {who}: {request}, {ref}, ronda {round}, antes de {break_date} ({days} dias, risco {risk} %, lugar {rank}; fator: {driver}; recargas segundo {source}). Tentativas anteriores: {history}.",
    "ht": "Pou {who}: {request}, {ref}, faz {round}, anvan {break_date} ({days} jou, risk {risk} %, plas {rank}; rezon: {driver}; rechaj dapre {source}). Sa ki te eseye: {history}.",
}
READ_ALOUD = {
    "en": "[For the worker to say, never sent] I am calling about your blood pressure medicine. Is anything in the way of the refill?",
    "es": "[Para decir en persona, nunca se envía] Llamo por su medicamento de la presión. ¿Algo impide la recarga?",
    "pt": "[Para dizer em pessoa, nunca enviado] Ligo por causa do seu medicamento da tensão. Algo impede a recarga?",
    "ht": "[Pou di an pèsòn, yo pa janm voye l] M ap rele pou medikaman tansyon ou. Èske gen yon bagay ki bloke rechaj la?",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _said(labels: dict[str, dict[str, str]], lang: str, key: Column) -> Column:
    return _map({k: v[lang] for k, v in labels.items()})[key]


def active_latency(selected: DataFrame) -> DataFrame:
    """The selected source and its greatest latency; without one, an unknown source without latency."""
    found = selected.agg(F.first("source", ignorenulls=True).alias("source"), F.first("max_latency", ignorenulls=True).alias("latency"))
    return found.select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("latency", F.lit(0)).alias("latency"))


def active_latencies(keys: DataFrame, attempts: DataFrame, key: str = "pid") -> DataFrame:
    """The same for each key, of the ``attempts`` by key."""
    served = attempts.where("outcome = 'served'").select(key, "source", F.col("max_latency").alias("latency"))
    rows = keys.select(key).distinct().join(served, key, "left")
    return rows.select(key, F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("latency", F.lit(0)).alias("latency"))


def round_schedule(cards: DataFrame, latency: int) -> DataFrame:
    """Of each round when it acts, when it escalates and when that is safe given the latency.

    Cards have ``entry_date, days_to_break``. Rounds chain on the safe boundary. A subject is
    unactionable if the source couldn't show a refill before the break.
    """
    runway = F.greatest(F.col("days_to_break"), F.lit(0.0))
    out = cards.withColumn("break_date", F.date_add("entry_date", F.floor(runway).cast("int")))
    before = F.col("entry_date")
    for r, lead in enumerate(LEAD_DAYS):
        after = LEAD_DAYS[r + 1] if r + 1 < len(LEAD_DAYS) else 0
        out = out.withColumn(f"wait_{r}", F.greatest(F.date_sub("break_date", lead), F.col("entry_date"), before))
        out = out.withColumn(f"escalate_{r}", F.greatest(F.date_sub("break_date", after), F.date_add(f"wait_{r}", DWELL_DAYS)))
        out = out.withColumn(f"effective_{r}", F.date_add(f"escalate_{r}", latency))
        before = F.col(f"effective_{r}")
    unactionable = (F.col("days_to_break") > 0) & (F.lit(latency) >= F.col("days_to_break"))
    out = out.withColumn("unactionable", F.coalesce(unactionable, F.lit(False)).cast("int"))
    return out.withColumn("wait_1", F.when(F.col("is_safety") == 1, F.col("entry_date")).otherwise(F.col("wait_1")))


BOUNDARIES = tuple(f"{p}_{r}" for r in range(3) for p in ("wait", "escalate", "effective"))


def boundary_offsets(cards: DataFrame, latency: int) -> DataFrame:
    """``(pid, offsets)``: the days after a subject's entry on which its status can change by the calendar alone, rising."""
    start = F.to_date(F.lit("2000-01-01"))
    timed = round_schedule(cards.select("pid", "is_safety", "days_to_break").withColumn("entry_date", start), latency)
    return timed.select("pid", F.array_sort(F.array_distinct(F.array(*(F.datediff(b, start) for b in BOUNDARIES)))).alias("offsets"))


def current_round(ref: Column) -> Column:
    """The highest round whose predecessors' safe boundary has passed; safety cases begin at round 1."""
    to_two = ref >= F.col("effective_1")
    normal = F.when((ref >= F.col("effective_0")) & to_two, 2).when(ref >= F.col("effective_0"), 1).otherwise(0)
    return F.when(F.col("is_safety") == 1, F.when(to_two, 2).otherwise(1)).otherwise(normal)


def round_action(number: Column) -> Column:
    first = F.when(F.col("is_safety") == 1, "social_worker").otherwise(F.coalesce(_map(ROUND1)[F.col("driver")], F.lit(ROUND1_DEFAULT)))
    return F.when(number == 0, "chw_pharmacy").when(number == 1, first).otherwise("prescriber")


def _at(prefix: str, number: Column) -> Column:
    return F.when(number == 0, F.col(f"{prefix}_0")).when(number == 1, F.col(f"{prefix}_1")).otherwise(F.col(f"{prefix}_2"))


def escalation_status(scheduled: DataFrame, outcomes: DataFrame, status: DataFrame, as_of: str | Column) -> DataFrame:
    """Status of each subject in fixed precedence, its round, and the round that closed it, as of a day or of a column of ``scheduled``.

    ``dispatch_dates`` (by round, from an earlier state) tells dispatched from pending. ``any_gated``
    is 1 if the action of any round up to the current one lacks consent.
    """
    today = as_of if isinstance(as_of, Column) else F.to_date(F.lit(as_of))
    rows = scheduled.join(outcomes.select("pid", "observed", "on_time_refill", "event_date"), "pid", "left")
    observed = F.coalesce(F.col("observed") == 1, F.lit(False))
    rows = rows.withColumn("ref", F.when(observed, F.coalesce("event_date", today)).otherwise(today))
    rows = rows.withColumn("round", current_round(F.col("ref"))).withColumn("action", round_action(F.col("round")))
    rows = gate(rows, status, keep=True)
    wait, escalate, effective = (_at(p, F.col("round")) for p in ("wait", "escalate", "effective"))
    if "dispatch_dates" not in rows.columns:
        rows = rows.withColumn("dispatch_dates", F.lit(None).cast("map<int,date>"))
    blocked = (F.col("allowed") == 0) & (F.col("scope") == "internal")
    state = (
        F.when(observed & (F.col("on_time_refill") == 1), "CLOSED")
        .when(observed, "EXHAUSTED")
        .when((F.col("round") == 2) & (today >= effective), "EXHAUSTED")
        .when(today < wait, "WAITING")
        .when(blocked, "GATED_ON_CONSENT")
        .when((today >= escalate) & (today < effective), "WAITING_ON_DATA_LATENCY")
        .when(F.col("dispatch_dates")[F.col("round")].isNotNull(), "DISPATCHED")
        .otherwise("PENDING")
    )
    rows = rows.withColumn("status", state).withColumn("wait_until", wait).withColumn("escalate_at", escalate).withColumn("effective_escalate_at", effective)
    any_gated = F.lit(False)
    for r in range(3):
        passed = F.when(scope_of(round_action(F.lit(r))) == "external", F.col("external_allowed")).otherwise(F.col("internal_allowed"))
        any_gated = any_gated | ((_first_round() <= r) & (F.col("round") >= r) & (passed == 0))
    rows = rows.withColumn("any_gated", any_gated.cast("int"))
    return rows.withColumn("closed_on_round", F.when(F.col("status") == "CLOSED", F.col("round")))


def _first_round() -> Column:
    return F.when(F.col("is_safety") == 1, 1).otherwise(0)


def _dispatched_on(number: Column, current: Column, hard: Column) -> Column:
    """When a round's message went out: as an earlier state has it, else when the round began to act.

    A round that consent blocks never sends, and a pending one has not yet.
    """
    wait = _at("wait", number)
    acts = (F.col("ref") >= wait) & ~F.col("status").isin("WAITING", "PENDING")
    return F.when(~hard & ((number < current) | acts), F.coalesce(F.col("dispatch_dates")[number], wait))


def round_rows(states: DataFrame, status: DataFrame) -> DataFrame:
    """A row for each round from the first to the current one: action, gating, fallback, timers and outcome."""
    kept = ["pid", "driver", "is_safety", "status", "ref", "break_date", "dispatch_dates", *(f"{p}_{r}" for p in ("wait", "escalate", "effective") for r in range(3))]
    rows = states.select(*kept, F.col("round").alias("current"), F.explode(F.sequence(_first_round(), F.col("round"))).alias("round"))
    rows = gate(rows.withColumn("action", round_action(F.col("round"))), status)
    gated, external = F.col("allowed") == 0, F.col("scope") == "external"
    hard = gated & ~external
    outcome = (
        F.when(F.col("round") < F.col("current"), F.when(hard, "gated_internal").otherwise("no_refill"))
        .when(F.col("status") == "CLOSED", "refill_observed")
        .when(F.col("status") == "GATED_ON_CONSENT", "gated")
        .when(F.col("status") == "EXHAUSTED", "no_refill")
        .otherwise("pending")
    )
    return rows.select(
        "pid", "round", "action", "scope", _at("wait", F.col("round")).alias("wait_until"), _at("escalate", F.col("round")).alias("escalate_at"), _at("effective", F.col("round")).alias("effective_escalate_at"),
        gated.cast("int").alias("gated"), F.when(gated, F.col("reason")).alias("consent_reason"), F.when(gated & external, _map(FALLBACK)[F.col("action")]).alias("fallback_action"),
        outcome.alias("outcome"), _dispatched_on(F.col("round"), F.col("current"), hard).alias("dispatched_on"), "driver", "break_date",
    )


def round_history(rows: DataFrame) -> DataFrame:
    """The rounds of a subject (three at most) as one ordered array."""
    parts = F.struct("round", "action", "outcome", "dispatched_on", "gated", "consent_reason", "fallback_action", "wait_until", "escalate_at", "effective_escalate_at")
    return rows.groupBy("pid").agg(F.array_sort(F.collect_list(parts)).alias("rounds"))


def gated_actions(rows: DataFrame) -> DataFrame:
    return rows.where("gated = 1").select("pid", "round", "action", "scope", F.col("consent_reason").alias("reason"), "fallback_action")


def recipients() -> dict[str, Column]:
    """Of a round's action or its fallback: who is written to, the kind of message and the mediator."""
    sent = F.coalesce("fallback_action", "action")
    return {name: _map({a: d[k] for a, d in DISPATCH.items() if d[k]})[sent] for k, name in enumerate(("recipient", "kind", "mediated_by"))}


def dispatch_recipient(rows: DataFrame) -> DataFrame:
    """Who is written to, what kind of message it is, and whom the recipient contacts in turn.

    A gated external action goes to its internal fallback; the subject is never a recipient.
    """
    return rows.select("pid", "round", *(c.alias(name) for name, c in recipients().items()))


def _told(rows: DataFrame) -> DataFrame:
    """Each round with who is written to and, by language, the rounds before it (``history``), oldest first.

    A subject's rounds (three at most) are gathered once, and each takes what stands before it in the array.
    """
    parts = [c for c in ("round", "outcome", "dispatched_on", "driver", "break_date") if c in rows.columns]
    own = rows.select("pid", F.struct(*parts, *(c.alias(name) for name, c in recipients().items())).alias("r"))
    gathered = own.groupBy("pid").agg(F.array_sort(F.collect_list("r"), lambda a, b: a["round"] - b["round"]).alias("rounds"))
    rounds = gathered.select("pid", "rounds", F.posexplode("rounds").alias("place", "r"))

    def before(lang: str) -> Column:
        line = lambda p: F.concat(F.lit(ROUND_WORDS[lang] + " "), p["round"], F.lit(" ("), _said(RECIPIENT_LABELS, lang, p["recipient"]), F.lit(") - "), F.coalesce(p["dispatched_on"].cast("string"), F.lit("-")), F.lit(" - "), _said(OUTCOME_WORDS, lang, p["outcome"]))
        return F.when(F.col("place") == 0, NO_HISTORY[lang]).otherwise(F.array_join(F.transform(F.slice("rounds", 1, F.col("place")), line), "; "))

    texts = F.create_map(*(x for lang in MESSAGES for x in (F.lit(lang), before(lang))))
    return rounds.select("pid", "r.*", texts.alias("history"))


def intervention_history(rows: DataFrame) -> DataFrame:
    """``(pid, round, lang, history)``: what was tried before each round, oldest first, in each language."""
    return _told(rows).select("pid", "round", F.explode("history").alias("lang", "history"))


def dispatch_messages(rows: DataFrame, cards: DataFrame | None = None, source: str = "unknown") -> DataFrame:
    """A message for each subject, round that was sent, and language, to a provider and never to the subject.

    The days to the break, the risk in per cent and the rank within the role come from the subject's
    card (``-`` without one), ``source`` tells where refills would show. Those who speak with the
    subject also get a script to read aloud.
    """
    from ..functions import deid_ref, render_template
    from .routing import DRIVER_LABELS, labels_of

    out = _told(rows).where("dispatched_on is not null")
    if cards is None:
        out = out.withColumns({c: F.lit(None).cast("int") for c in ("days", "risk_pct", "rank_in_role")})
    else:
        known = cards.select("pid", F.floor("days_to_break").cast("int").alias("days"), F.round(100 * F.col("risk")).cast("int").alias("risk_pct"), "rank_in_role")
        out = out.join(known, "pid", "left")
    out = out.select("*", F.explode("history").alias("lang", "before"))
    by_lang = lambda f: F.coalesce(*(F.when(F.col("lang") == lang, f(lang)) for lang in MESSAGES))
    out = out.withColumn("recipient_label", by_lang(lambda lang: _said(RECIPIENT_LABELS, lang, F.col("recipient"))))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    fields = {
        "who": F.col("recipient_label"), "request": by_lang(lambda lang: _said(REQUESTS, lang, F.col("kind"))), "ref": deid_ref(F.col("pid")), "round": F.col("round"), "break_date": F.col("break_date"),
        "driver": by_lang(lambda lang: labels_of(F.col("driver"), DRIVER_LABELS, lang)), "history": F.col("before"), "days": known("days"), "risk": known("risk_pct"), "rank": known("rank_in_role"), "source": F.lit(source),
    }
    body = render_template(_map(MESSAGES)[F.col("lang")], fields)
    script = F.when(F.col("recipient").isin(*READERS), _map(READ_ALOUD)[F.col("lang")])
    return out.select(
        "pid", "round", "lang", "recipient", "recipient_label", "kind", "mediated_by", F.lit("provider_or_organization").alias("addressed_to"),
        "days", "risk_pct", "rank_in_role", F.lit(source).alias("refill_source"), body.alias("body"), script.alias("read_aloud"),
    )


def advance_state(cards: DataFrame, outcomes: DataFrame, status: DataFrame, prior: DataFrame | None, as_of: str, latency: int) -> DataFrame:
    """One tick: entry date and days freeze when a subject is first seen; what is due is dispatched today.

    The dates of dispatches stay as first recorded, so the same inputs give the same state, also on top of it.
    """
    today = F.to_date(F.lit(as_of))
    fresh = cards.select("pid", "driver", "is_safety", "days_to_break")
    if prior is None:
        rows = fresh.withColumn("entry_date", today).withColumn("dispatch_dates", F.lit(None).cast("map<int,date>"))
    else:
        frozen = prior.select("pid", F.col("entry_date").alias("e"), F.col("days_to_break").alias("d"), "dispatch_dates")
        rows = fresh.join(frozen, "pid", "left").withColumn("entry_date", F.coalesce("e", today)).withColumn("days_to_break", F.coalesce("d", "days_to_break")).drop("e", "d")
    states = escalation_status(round_schedule(rows, latency), outcomes, status, as_of)
    dates = []
    for r in range(3):
        number = F.lit(r)
        hard = (scope_of(round_action(number)) == "internal") & (F.col("internal_allowed") == 0)
        stamped = F.when((F.col("round") == r) & (F.col("status") == "PENDING"), today).otherwise(_dispatched_on(number, F.col("round"), hard))
        dates.append(F.struct(number.alias("round"), F.when((_first_round() <= r) & (F.col("round") >= r), stamped).alias("day")))
    sent = F.map_from_entries(F.filter(F.array(*dates), lambda x: x["day"].isNotNull()))
    states = states.withColumn("dispatch_dates", sent).withColumn("status", F.when(F.col("status") == "PENDING", "DISPATCHED").otherwise(F.col("status")))
    return states.withColumn("as_of", today)


def escalation_funnel(states: DataFrame) -> DataFrame:
    """``(measure, key, n)``; the statuses, and the rounds, each sum to all."""
    total = states.select(F.lit("total").alias("measure"), F.lit("all").alias("key"))
    parts = [
        states.select(F.lit("status"), "status"),
        states.select(F.lit("round"), F.col("round").cast("string")),
        states.where("closed_on_round is not null").select(F.lit("closed_on_round"), F.col("closed_on_round").cast("string")),
        states.where("any_gated = 1").select(F.lit("gated"), F.lit("all")),
        states.where("unactionable = 1").select(F.lit("unactionable"), F.lit("all")),
    ]
    for p in parts:
        total = total.union(p)
    return total.groupBy("measure", "key").agg(F.count("*").alias("n"))
