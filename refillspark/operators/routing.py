"""Routing: from attributed drivers to an action, its rationale and a place in a capped worklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import min_max_scale, render_template
from ..storage import kept

#: Driver, action, secondary action, place in the clinical hierarchy (fixed values of this package's rules).
RULES = [
    ("access", "social_worker", None, 1),
    ("cost", "social_worker", None, 2),
    ("isolation", "chw_call", "social_worker", 3),
    ("bp_trend", "pharmacist", None, 4),
    ("safety", "social_worker", None, None),
]
FALLBACKS = [("regimen", "bp_trend")]
ACTIONS = ("social_worker", "pharmacist", "chw_call")
#: What the rationale says where the hierarchy decided.
TIE_BREAK = {
    "en": " [Close call: the first driver is under {margin} times the second; the clinical order decides.]",
    "es": " [Empate: el primer factor no llega a {margin} veces el segundo; decide el orden clínico.]",
    "pt": " [Empate: o primeiro fator não chega a {margin} vezes o segundo; decide a ordem clínica.]",
    "ht": " [Egalite: premye rezon an pa rive {margin} fwa dezyèm nan; lòd klinik la deside.]",
}
ACTION_LABELS = {
    "pharmacist": {"en": "Pharmacist review", "es": "Revisión por farmacia", "pt": "Revisão pela farmácia", "ht": "Revizyon famasyen"},
    "social_worker": {"en": "Social worker contact", "es": "Contacto de trabajo social", "pt": "Contacto do serviço social", "ht": "Kontak travayè sosyal"},
    "chw_call": {"en": "Health worker call", "es": "Llamada del agente de salud", "pt": "Chamada do agente de saúde", "ht": "Apèl ajan sante"},
}
DRIVER_LABELS = {
    "access": {"en": "Getting there", "es": "Acceso", "pt": "Acesso", "ht": "Aksè"},
    "cost": {"en": "Cost", "es": "Costo", "pt": "Custo", "ht": "Pri"},
    "isolation": {"en": "Isolation", "es": "Aislamiento", "pt": "Isolamento", "ht": "Izolman"},
    "bp_trend": {"en": "Blood pressure trend", "es": "Tendencia de la presión", "pt": "Tendência da tensão", "ht": "Tandans tansyon"},
    "safety": {"en": "Safety", "es": "Seguridad", "pt": "Segurança", "ht": "Sekirite"},
}
LANGUAGES = {
    "en": "Main driver: {driver} ({value}). Action: {action}.",
    "es": "Factor principal: {driver} ({value}). Acción: {action}.",
    "pt": "Fator principal: {driver} ({value}). Ação: {action}.",
    "ht": "Rezon prensipal: {driver} ({value}). Aksyon: {action}.",
}


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "driver string, action string, secondary_action string, hierarchy int")


def validate_rules(rules: DataFrame, actions: tuple[str, ...] = ACTIONS, hierarchy: DataFrame | None = None) -> DataFrame:
    """``(driver, fault, detail)``: rules whose action doesn't exist, and drivers of the ``hierarchy (driver)`` without a rule; no rows if all is well."""
    faults = rules.where(~F.col("action").isin(*actions)).select("driver", F.lit("unknown_action").alias("fault"), F.col("action").alias("detail"))
    if hierarchy is None:
        return faults
    lost = hierarchy.join(rules, "driver", "left_anti").select("driver", F.lit("unknown_driver").alias("fault"), F.lit("clinical_hierarchy").alias("detail"))
    return faults.union(lost.distinct())


def remap_fallback(attributions: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Drivers out of scope count for their fallback."""
    rows = attributions.join(F.broadcast(fallbacks), "driver", "left")
    return rows.groupBy("pid", F.coalesce("fallback", "driver").alias("driver")).agg(F.sum("value").alias("value"))


def safety_flags(attributions: DataFrame, safety: str = "safety") -> DataFrame:
    """From the raw data, never from an attribution's sign."""
    return attributions.where(F.col("driver") == safety).groupBy("pid").agg((F.max("raw") > 0).cast("int").alias("is_safety"), F.max("raw").alias("raw"))


def resolve_driver(remapped: DataFrame, rules: DataFrame, margin: float = 1.25, safety: str = "safety") -> DataFrame:
    """The top driver if it is clear of the second by ``margin``, or if no candidate is in the hierarchy; else the first there. Without a candidate ``bp_trend``."""
    rows = remapped.where((F.col("driver") != safety) & (F.col("value") > 0)).join(F.broadcast(rules.select("driver", "hierarchy")), "driver", "left")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("value"), "driver")))
    found = ranked.groupBy("pid").agg(
        F.max(F.when(F.col("n") == 1, F.struct("driver", "value"))).alias("top"),
        F.max(F.when(F.col("n") == 2, F.col("value"))).alias("second"),
        F.min(F.when(F.col("hierarchy").isNotNull(), F.struct("hierarchy", "driver", "value"))).alias("first"),
    )
    out = remapped.select("pid").distinct().join(found, "pid", "left")
    clear = F.col("top").isNotNull() & (F.col("second").isNull() | (F.col("second") <= 0) | (F.col("top.value") >= margin * F.col("second")))
    return out.select(
        "pid",
        F.when(clear, F.col("top.driver")).otherwise(F.coalesce("first.driver", "top.driver", F.lit("bp_trend"))).alias("driver"),
        F.when(clear, F.col("top.value")).otherwise(F.coalesce("first.value", "top.value", F.lit(0.0))).alias("value"),
        (~clear).cast("int").alias("by_hierarchy"),
    )


def decide(attributions: DataFrame, rules: DataFrame, fallbacks: DataFrame, margin: float = 1.25) -> DataFrame:
    """Action, secondary action, rationale in four languages and the candidates, for each subject.

    A driver without a rule can't be routed: that raises an error, since a card without an action
    would be lost on the way to a worklist (``validate_rules`` lists such drivers beforehand).
    """
    remapped = remap_fallback(attributions, fallbacks)
    resolved = resolve_driver(remapped, rules, margin).join(safety_flags(attributions), "pid", "left")
    forced = F.coalesce(F.col("is_safety") == 1, F.lit(False))
    chosen = resolved.select(
        "pid", F.when(forced, "safety").otherwise(F.col("driver")).alias("driver"), F.when(forced, F.col("raw")).otherwise(F.col("value")).alias("value"),
        forced.cast("int").alias("is_safety"), F.when(forced, 0).otherwise(F.col("by_hierarchy")).alias("by_hierarchy"),
    )
    ruled = chosen.join(F.broadcast(rules.select("driver", "action", "secondary_action", F.lit(True).alias("ruled"))), "driver", "left")
    no_rule = F.raise_error(F.concat(F.lit("no rule for driver "), F.coalesce("driver", F.lit("null"))))
    ruled = ruled.withColumn("action", F.when(F.col("ruled"), F.col("action")).otherwise(no_rule.cast("string")))
    fields = {"driver": F.col("driver"), "value": F.round("value", 3).cast("decimal(10,3)"), "action": F.col("action")}
    note = lambda lang: F.when(F.col("by_hierarchy") == 1, F.lit(TIE_BREAK[lang].format(margin=margin))).otherwise("")
    texts = F.create_map(*(x for lang, t in LANGUAGES.items() for x in (F.lit(lang), F.concat(render_template(F.lit(t), fields), note(lang)))))
    positive = F.collect_list(F.when((F.col("value") > 0) & (F.col("driver") != "safety"), F.struct((-F.col("value")).alias("minus"), "driver")))
    candidates = remapped.groupBy("pid").agg(F.transform(F.array_sort(positive), lambda x: x["driver"]).alias("candidates"))
    return ruled.join(candidates, "pid", "left").select("pid", "driver", F.round("value", 6).alias("value"), "is_safety", "by_hierarchy", "action", "secondary_action", texts.alias("rationale"), "candidates")


def days_to_break(risk: Column, days: int = 180) -> Column:
    return (1 - risk) * days


def priority_score(days: Column, weight: Column) -> Column:
    """Urgency times the driver's weight scaled within the role; a missing day count is far away."""
    far = F.coalesce(days, F.lit(999.0))
    return 1 / (1 + F.greatest(far, F.lit(0.0))) * weight


def pool_summary(cards: DataFrame) -> DataFrame:
    """Cards by action, and their total."""
    counts = cards.rollup("action").agg(F.count("*").alias("n"), F.grouping("action").alias("all"))
    return counts.select(F.when(F.col("all") == 1, "total").otherwise(F.col("action")).alias("action"), "n")


def build_worklist(decisions: DataFrame, scores: DataFrame, caps: DataFrame) -> DataFrame:
    """The cards: decision, days to the predicted break, priority, rank within the role and whether the cap takes it.

    Scaling, ranking and caps each read the cards twice, so these are stored before.
    """
    from .windows import apply_caps, rank_in_role

    joined = decisions.join(scores.select("pid", "stratum", "risk"), "pid")
    rows = kept(joined.withColumns({"role": F.col("action"), "needs_review": F.col("is_safety"), "days_to_break": F.round(days_to_break(F.col("risk")), 6)}), "cards")
    rows = min_max_scale(rows, F.abs("value"), "role", "weight")
    rows = rows.withColumn("score", F.round(priority_score(F.col("days_to_break"), F.col("weight")), 9)).drop("weight")
    return apply_caps(rank_in_role(rows), caps)


def labels_of(key: Column, labels: dict[str, dict[str, str]], lang: str) -> Column:
    """The label in a language; what has none stands for itself."""
    pairs = F.create_map(*(F.lit(x) for name, said in labels.items() for x in (name, said[lang])))
    return F.coalesce(pairs[key], key)


def worklist_meta(cards: DataFrame, caps: DataFrame, version: int = 1) -> DataFrame:
    """One row: cohort size, cards taken, capacity, the cap used and the expansion of each role, and the version of the rules.

    A role without a cap uses as many as it has cards. Maps have an entry a role; cards without a
    role count in the sums only.
    """
    own = caps.where("role is not null and cap is not null").groupBy("role").agg(F.max("cap").alias("cap"))
    by_role = cards.groupBy("role").agg(F.count("*").alias("n"), F.sum("included").alias("taken"), F.max("effective_cap").alias("used")).join(F.broadcast(own), "role", "left")
    by_role = by_role.withColumn("beyond", F.greatest(F.col("used") - F.coalesce("cap", "n"), F.lit(0)))
    entries = lambda value, when: F.map_from_entries(F.array_sort(F.collect_list(F.when(when & F.col("role").isNotNull(), F.struct("role", value)))))
    return by_role.agg(
        F.sum("n").alias("cohort_size"), F.sum("taken").alias("n_taken"), F.sum("used").alias("capacity"),
        entries("used", F.col("used").isNotNull()).alias("caps_used"), entries("beyond", F.col("beyond") > 0).alias("expansions"), F.lit(version).alias("rules_version"),
    )
