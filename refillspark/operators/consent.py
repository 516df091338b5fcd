"""Consent: what is allowed on a day, failing closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scope that each action needs (fixed values).
SCOPES = {
    "chw_pharmacy": "internal",
    "social_worker": "internal",
    "pharmacist": "internal",
    "bilingual_chw": "internal",
    "prescriber": "internal",
    "chw_transport_support": "internal",
    "transit_voucher": "external",
}
FALLBACK = {"transit_voucher": "chw_transport_support"}


def scope_of(action: Column) -> Column:
    return F.create_map(*(x for a, s in SCOPES.items() for x in (F.lit(a), F.lit(s))))[action]


def consent_status(subjects: DataFrame, consent: DataFrame, as_of: str, validity: int = 365) -> DataFrame:
    """Of each scope: state, whether it is stale (no date, or too old) and whether it allows anything."""
    day = F.to_date(F.lit(as_of))
    rows = subjects.select("pid").join(consent, "pid", "left")
    stale = (F.col("as_of").isNull() | (F.datediff(day, "as_of") > validity)).cast("int")
    out = rows.withColumn("stale", stale)
    for scope in ("internal", "external"):
        out = out.withColumn(scope, F.coalesce(scope, F.lit("unknown")))
        out = out.withColumn(f"{scope}_allowed", ((F.col(scope) == "granted") & (F.col("stale") == 0)).cast("int"))
    return out.select("pid", "internal", "external", "stale", "internal_allowed", "external_allowed")


def gate(rows: DataFrame, status: DataFrame, action: str = "action", keep: bool = False) -> DataFrame:
    """Adds ``scope``, ``allowed`` and ``reason`` (with ``keep`` also what each scope allows); an action without a declared scope is an error, not a pass."""
    out = rows.join(status, "pid", "left").withColumn("scope", scope_of(F.col(action)))
    external = F.col("scope") == "external"
    state = F.coalesce(F.when(external, F.col("external")).otherwise(F.col("internal")), F.lit("unknown"))
    allowed = F.coalesce(F.when(external, F.col("external_allowed")).otherwise(F.col("internal_allowed")), F.lit(0))
    reason = (
        F.when(F.col("scope").isNull(), "undeclared_action")
        .when(state == "denied", "denied")
        .when(state == "unknown", "unknown_not_received")
        .when(F.coalesce("stale", F.lit(1)) == 1, "stale_consent")
        .otherwise("authorized")
    )
    out = out.withColumn("allowed", F.when(F.col("scope").isNull(), 0).otherwise(allowed)).withColumn("reason", reason)
    out = out.drop("internal", "external", "stale")
    if not keep:
        return out.drop("internal_allowed", "external_allowed")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal_allowed", "external_allowed")})


def stale_horizon(consent: DataFrame, as_of_end: str, validity: int = 365) -> DataFrame:
    """Whether a run that ends on a day outlives the freshest consent."""
    days = F.datediff(F.to_date(F.lit(as_of_end)), F.max("as_of"))
    return consent.agg(F.max("as_of").alias("freshest"), F.coalesce(days > validity, F.lit(True)).cast("int").alias("outlives_consent"))
