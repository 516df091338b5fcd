"""Serving views: flat rows, countdowns and key figures over the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import deid_ref, display_window
from .escalation import ROUND_WORDS, recipients
from .routing import ACTION_LABELS, DRIVER_LABELS, LANGUAGES, labels_of


def escalation_blocks(states: DataFrame, as_of: str, rounds: DataFrame | None = None, consent: DataFrame | None = None) -> DataFrame:
    """``(pid, escalation)``: where each subject stands.

    Round with its label by language, status, countdowns and the break; what each scope allows
    (``consent``: see ``consent_status``); and from the rounds (see ``round_rows``) the gated
    actions, what was dispatched and came of it, in order, and the dispatch of the current round if
    it went out. Without ``rounds`` or ``consent`` these parts are null.
    """
    timed = escalation_countdown(states, as_of).drop("status")
    known = states.select("pid", "status", "round", "break_date", "unactionable", "any_gated").join(timed, "pid")
    if rounds is None:
        known = known.withColumns({
            "gated_actions": F.lit(None).cast("array<struct<round:int,action:string,consent_reason:string,fallback_action:string>>"),
            "dispatch_history": F.lit(None).cast("array<struct<round:int,recipient:string,mediated_by:string,dispatched_on:date,outcome:string>>"),
            "current_dispatch": F.lit(None).cast("struct<recipient:string,kind:string,mediated_by:string>"),
        })
    else:
        told = rounds.select("pid", "round", "action", "gated", "consent_reason", "fallback_action", "dispatched_on", "outcome", *(c.alias(name) for name, c in recipients().items()))
        told = told.join(states.select("pid", F.col("round").alias("current")), "pid")
        now = (F.col("round") == F.col("current")) & F.col("dispatched_on").isNotNull()
        gathered = told.groupBy("pid").agg(  # three rounds at most
            F.array_sort(F.collect_list(F.when(F.col("gated") == 1, F.struct("round", "action", "consent_reason", "fallback_action")))).alias("gated_actions"),
            F.array_sort(F.collect_list(F.struct("round", "recipient", "mediated_by", "dispatched_on", "outcome"))).alias("dispatch_history"),
            F.max(F.when(now, F.struct("recipient", "kind", "mediated_by"))).alias("current_dispatch"),
        )
        known = known.join(gathered, "pid", "left")
    scopes = ("internal", "external", "stale", "internal_allowed", "external_allowed")
    if consent is None:
        known = known.withColumn("consent", F.lit(None).cast("struct<internal:string,external:string,stale:int,internal_allowed:int,external_allowed:int>"))
    else:
        known = known.join(consent.select("pid", F.struct(*scopes).alias("consent")), "pid", "left")
    labels = F.create_map(*(x for lang, word in ROUND_WORDS.items() for x in (F.lit(lang), F.concat(F.lit(word + " "), F.col("round")))))
    known = known.withColumn("round_label", labels)
    parts = ("round", "round_label", "status", "days_remaining", "days_until_latency_clears", "break_date", "unactionable", "any_gated", "consent", "gated_actions", "dispatch_history", "current_dispatch")
    return known.select("pid", F.struct(*parts).alias("escalation"))


def worklist_view(
    cards: DataFrame, states: DataFrame, as_of: str, messages: DataFrame | None = None, outcomes: DataFrame | None = None, rounds: DataFrame | None = None, consent: DataFrame | None = None
) -> DataFrame:
    """The cards taken, with labels, messages and scripts by language, the outcome and the escalation; earliest window first.

    Without an escalation state ``escalation`` (see ``escalation_blocks``) is null. Where the current
    round has sent no message (``messages``: see ``dispatch_messages``) the routing's rationale stands
    in, without a script.
    """
    start, end = display_window(F.to_date(F.lit(as_of)), F.col("days_to_break"))
    view = cards.where("included = 1").join(escalation_blocks(states, as_of, rounds, consent), "pid", "left")
    if messages is None:
        view = view.withColumns({"said": F.lit(None).cast("map<string,string>"), "aloud": F.lit(None).cast("map<string,string>")})
    else:
        entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("lang", c)))))
        now = messages.join(states.select("pid", "round"), ["pid", "round"], "left_semi")
        view = view.join(now.groupBy("pid").agg(entries("body").alias("said"), entries("read_aloud").alias("aloud")), "pid", "left")
    if outcomes is None:
        view = view.withColumn("on_time_refill", F.lit(None).cast("int"))
    else:
        view = view.join(outcomes.select("pid", "on_time_refill"), "pid", "left")
    labels = F.create_map(*(x for lang in LANGUAGES for x in (F.lit(lang), labels_of(F.col("driver"), DRIVER_LABELS, lang))))
    actions = F.create_map(*(x for lang in LANGUAGES for x in (F.lit(lang), labels_of(F.col("action"), ACTION_LABELS, lang))))
    return view.select(
        "pid", deid_ref(F.col("pid")).alias("name"), F.lit("en").alias("preferred_language"), start.alias("window_start"), end.alias("window_end"), "risk", "driver", labels.alias("driver_label"), "action", actions.alias("action_label"),
        "score", F.col("needs_review").alias("requires_review"), "is_safety", F.coalesce("said", "rationale").alias("message"), F.col("aloud").alias("read_aloud"), "on_time_refill", "escalation",
    ).orderBy("window_start", "pid")


def escalation_countdown(states: DataFrame, as_of: str) -> DataFrame:
    """Days to the boundary that matters in the present status (negative once it has passed); null when it is over."""
    today = F.to_date(F.lit(as_of))
    until = F.when(F.col("status") == "WAITING", F.col("wait_until")).when(F.col("status") == "WAITING_ON_DATA_LATENCY", F.col("effective_escalate_at")).when(~F.col("status").isin("CLOSED", "EXHAUSTED"), F.col("escalate_at"))
    clears = F.when(F.col("status") == "WAITING_ON_DATA_LATENCY", F.datediff("effective_escalate_at", today))
    return states.select("pid", "status", F.datediff(until, today).alias("days_remaining"), clears.alias("days_until_latency_clears"))


def source_status(attempts: DataFrame, profiles: DataFrame, key: str = "pid") -> DataFrame:
    """Of each course of attempts: the source that served (null if none did), how it is reached, its whole latency profile, and for how many keys."""
    rows = attempts.select(key, "position", "source", "outcome")
    trace = F.transform(F.array_sort(F.collect_list(F.struct("position", "source", "outcome"))), lambda t: F.concat_ws(":", t["source"], t["outcome"]))
    each = rows.groupBy(key).agg(F.array_join(trace, ";").alias("trace"), F.max(F.when(F.col("outcome") == "served", F.col("source"))).alias("source"))
    courses = each.groupBy("source", "trace").agg(F.count("*").alias("subjects"))
    latency = ("min_latency", "typical_latency", "max_latency")
    return courses.join(F.broadcast(profiles.select("source", "access_mode", *latency)), "source", "left").select("source", "access_mode", *latency, "trace", "subjects")


def subject_lookup(view: DataFrame, pid) -> DataFrame:
    return view.where(F.col("pid") == pid)


def worklist_kpis(cards: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of key figures. Only an on-time refill closes a loop; a confirmed break doesn't."""
    rows = cards.where("included = 1").join(outcomes.select("pid", "on_time_refill"), "pid", "left")
    by_action = rows.groupBy("action").agg(
        F.count("*").alias("n"), F.count_if((F.col("is_safety") == 1) | (F.col("needs_review") == 1)).alias("s"), F.count_if(F.col("on_time_refill") == 1).alias("t"), F.count_if(F.col("on_time_refill") == 0).alias("b"), F.max("risk").alias("r")
    )
    of = lambda action: F.coalesce(F.sum(F.when(F.col("action") == action, F.col("n"))), F.lit(0))
    return by_action.agg(
        F.sum("n").alias("routed"), F.sum("s").alias("safety"), F.sum("t").alias("on_time"), F.sum("b").alias("breaks"), F.round(100 * F.max("r"), 4).alias("peak_risk_pct"),
        (F.sum("n") - F.sum("t")).alias("open_loops"), *(of(a).alias(f"n_{a}") for a in ACTION_LABELS),
        F.max_by("action", F.struct("n", "action")).alias("dominant_route"), F.round(100 * F.max("n") / F.sum("n"), 4).alias("dominant_route_pct"),
    )


def cascade_counts(states: DataFrame) -> DataFrame:
    """A row for each round, also an empty one; ``gated`` counts those with any gated action."""
    gated = (F.col("any_gated") == 1) | (F.col("status") == "GATED_ON_CONSENT")
    counts = states.groupBy("round").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "CLOSED").alias("closed"), F.count_if(F.col("status") == "EXHAUSTED").alias("exhausted"), F.count_if(gated).alias("gated"))
    rounds = states.sparkSession.range(3).select(F.col("id").cast("int").alias("round"))
    out = F.broadcast(rounds).join(counts, "round", "left").fillna(0)
    return out.withColumn("in_flight", F.col("total") - F.col("closed") - F.col("exhausted"))


def worklist_filter(
    view: DataFrame, text: str = "", action: str | None = None, least_risk: float = 0.0, sort: str = "window_start", most: int | None = None, *,
    status: str | None = None, round_number: int | None = None, descending: bool | None = None,
) -> DataFrame:
    """Search and facets over the view; ``most`` is a page size.

    The text is looked for in the name, the id, codes and all languages' labels, whatever the case.
    ``status`` and ``round_number`` are facets of the escalation. The window sorts upwards and risk
    and priority downwards, unless ``descending`` says otherwise; nulls come last, the id decides ties.
    """
    said = [F.concat_ws(" ", F.map_values(c)) for c in ("driver_label", "action_label") if c in view.columns]
    found = F.contains(F.lower(F.concat_ws(" ", "name", F.col("pid").cast("string"), "driver", "action", *said)), F.lit(text.lower()))
    rows = view.where(found & (F.col("risk") >= least_risk))
    of = lambda c: F.col(f"escalation.{c}" if "escalation" in view.columns else c)
    for column, wanted in ((F.col("action"), action), (of("status"), status), (of("round"), round_number)):
        if wanted is not None:
            rows = rows.where(column == wanted)
    by = {"window_start": "window_start", "risk": "risk", "priority": "score"}[sort]
    down = sort != "window_start" if descending is None else descending
    rows = rows.orderBy(F.desc_nulls_last(by) if down else F.asc_nulls_last(by), "pid")
    return rows.limit(most) if most is not None else rows


def urgency_index(cards: DataFrame) -> DataFrame:
    """Whole per cent of the highest score, 1 at least; the maximum is an aggregate, not a window over all rows."""
    most = cards.agg(F.max("score").alias("most"))
    index = F.when(F.col("most") > 0, F.greatest(F.lit(1), F.round(100 * F.col("score") / F.col("most")).cast("int"))).otherwise(1)
    return cards.join(F.broadcast(most)).select("pid", index.alias("urgency"))
