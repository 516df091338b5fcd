"""Queries over ranking, evaluation and routing, with the same results in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import routing as R
from ..operators import windows as W
from .features import query as _query
from .lens import with_frames

Q: dict = {}
SQL: dict[str, str] = {}
CAPS = [("social_worker", 40), ("pharmacist", 25)]
MODIFIABLE = ["access", "cost", "isolation", "bp_trend"]


def query(name: str, sql: str | None = None):
    from . import features

    def add(f):
        out = _query(name, sql)(f)
        Q[name] = features.Q.pop(name)
        if sql:
            SQL[name] = features.SQL.pop(name)
        return out

    return add


def _rules(z):
    return R.rules_table(z.spark)


def _fallbacks(z):
    return z.spark.createDataFrame(R.FALLBACKS, "driver string, fallback string")


def _caps(z):
    return z.spark.createDataFrame(CAPS, "role string, cap int")


def _values(rows, names: str) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def said(template: str, fields: dict[str, str]) -> str:
    """The SQL text of a template whose ``{name}`` are SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({fields[x]})" if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(parts) if x)


_RULES = f"rules AS (SELECT * FROM {_values(R.RULES, 'driver, action, secondary_action, hierarchy')})"
_REMAP = f", remapped AS (SELECT pid, CASE driver WHEN 'regimen' THEN 'bp_trend' ELSE driver END AS driver, sum(value) AS value FROM attributions GROUP BY ALL), {_RULES}"
_SAFE = ", safe AS (SELECT pid, (max(raw) > 0)::INT AS is_safety, max(raw) AS raw FROM attributions WHERE driver = 'safety' GROUP BY pid)"
_RESOLVED = """, pos AS (SELECT r.*, hierarchy, row_number() OVER (PARTITION BY pid ORDER BY value DESC, driver) AS n FROM remapped r LEFT JOIN rules USING (driver) WHERE driver <> 'safety' AND value > 0),
    tops AS (SELECT pid, max(driver) FILTER (n = 1) AS td, max(value) FILTER (n = 1) AS tv, max(value) FILTER (n = 2) AS sv, arg_min(driver, hierarchy) FILTER (hierarchy IS NOT NULL) AS hd, arg_min(value, hierarchy) FILTER (hierarchy IS NOT NULL) AS hv FROM pos GROUP BY pid),
    resolved AS (SELECT pid, CASE WHEN clear THEN td ELSE coalesce(hd, td, 'bp_trend') END AS driver, CASE WHEN clear THEN tv ELSE coalesce(hv, tv, 0) END AS value, (NOT clear)::INT AS by_hierarchy
        FROM (SELECT *, td IS NOT NULL AND (sv IS NULL OR sv <= 0 OR tv >= 1.25 * sv) AS clear FROM (SELECT DISTINCT pid FROM remapped) LEFT JOIN tops USING (pid)))"""
_DECIDED = """, chosen AS (SELECT pid, CASE WHEN is_safety = 1 THEN 'safety' ELSE driver END AS driver, CASE WHEN is_safety = 1 THEN raw ELSE value END AS value, is_safety,
        CASE WHEN is_safety = 1 THEN 0 ELSE by_hierarchy END AS by_hierarchy FROM resolved JOIN safe USING (pid)),
    decided AS (SELECT pid, driver, round(value, 6) AS value, is_safety, by_hierarchy, action, secondary_action FROM chosen LEFT JOIN rules USING (driver))"""
_CARDS = f""", caps AS (SELECT * FROM {_values(CAPS, 'role, cap')}),
    cards0 AS (SELECT d.*, stratum, risk, action AS role, is_safety AS needs_review, round((1 - risk) * 180, 6) AS days_to_break FROM decided d JOIN scores USING (pid)),
    cards1 AS (SELECT *, min(abs(value)) OVER w AS lo, max(abs(value)) OVER w AS hi FROM cards0 WINDOW w AS (PARTITION BY role)),
    cards2 AS (SELECT * EXCLUDE (lo, hi), round(1 / (1 + greatest(days_to_break, 0)) * CASE WHEN hi > lo THEN 0.1 + (abs(value) - lo) / (hi - lo) * 0.9 ELSE 1.0 END, 9) AS score FROM cards1),
    cards3 AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY needs_review DESC, score DESC, pid) AS rank_in_role FROM cards2),
    cards AS (SELECT c.*, coalesce(cap, count(*) OVER (PARTITION BY role)) AS cap0, sum(needs_review) OVER (PARTITION BY role) AS reviews FROM cards3 c LEFT JOIN caps USING (role)),
    worklist AS (SELECT * EXCLUDE (cap0, reviews), greatest(cap0, reviews)::INT AS effective_cap, (reviews > cap0 AND needs_review = 1)::INT AS expanded, (rank_in_role <= greatest(cap0, reviews))::INT AS included FROM cards)"""
WORKLIST_SQL = _REMAP + _SAFE + _RESOLVED + _DECIDED + _CARDS
WORKLIST_FRAMES = ("attributions", "scores")
_PLAIN = ["pid", "driver", "value", "is_safety", "by_hierarchy", "action", "secondary_action"]


def decided(z):
    return R.decide(z.attributions(), _rules(z), _fallbacks(z))


def worklist(z):
    return R.build_worklist(decided(z), z.scores(), _caps(z))


# ---- routing ------------------------------------------------------------------------------------


_PART_RULES = """ WITH rules AS (SELECT p_brand AS driver, ['social_worker', 'pharmacist', 'chw_call', 'fax'][1 + min(p_size) % 4] AS action FROM part GROUP BY p_brand),
    hierarchy AS (SELECT DISTINCT 'Brand#' || (10 + p_size) AS driver FROM part)"""


@query("r1_validate_rules", _PART_RULES + """ SELECT driver, 'unknown_action' AS fault, action AS detail FROM rules WHERE action NOT IN ('social_worker', 'pharmacist', 'chw_call')
    UNION ALL SELECT driver, 'unknown_driver', 'clinical_hierarchy' FROM hierarchy WHERE driver NOT IN (SELECT driver FROM rules)""")
def _(z):
    actions = F.array(*map(F.lit, (*R.ACTIONS, "fax")))
    rules = z.table("part").groupBy(F.col("p_brand").alias("driver")).agg(F.element_at(actions, (F.min("p_size") % 4 + 1).cast("int")).alias("action"))
    hierarchy = z.table("part").select(F.concat(F.lit("Brand#"), F.col("p_size") + 10).alias("driver"))
    return R.validate_rules(rules, hierarchy=hierarchy)


@query("r2_safety_override", with_frames(_SAFE + " SELECT pid, is_safety, raw FROM safe", "attributions"))
def _(z):
    return R.safety_flags(z.attributions())


@query("r3_remap_fallback", with_frames(_REMAP + " SELECT pid, driver, round(value, 6) AS value FROM remapped", "attributions"))
def _(z):
    return R.remap_fallback(z.attributions(), _fallbacks(z)).withColumn("value", F.round("value", 6))


@query("r4_resolve_driver", with_frames(_REMAP + _RESOLVED + " SELECT pid, driver, round(value, 6) AS value, by_hierarchy FROM resolved", "attributions"))
def _(z):
    return R.resolve_driver(R.remap_fallback(z.attributions(), _fallbacks(z)), _rules(z)).withColumn("value", F.round("value", 6))


@query("r4_resolve_beside_hierarchy", with_frames(_REMAP.replace(_RULES, _RULES.replace("SELECT * FROM", "SELECT * REPLACE (CASE WHEN driver = 'isolation' THEN hierarchy END AS hierarchy) FROM")) + _RESOLVED + " SELECT pid, driver, round(value, 6) AS value, by_hierarchy FROM resolved", "attributions"))
def _(z):
    rules = _rules(z).withColumn("hierarchy", F.when(F.col("driver") == "isolation", F.col("hierarchy")))
    return R.resolve_driver(R.remap_fallback(z.attributions(), _fallbacks(z)), rules).withColumn("value", F.round("value", 6))


def rationale_sql(lang: str, of: str = "") -> str:
    fields = {"driver": f"{of}driver", "value": f"round({of}value, 3)::DECIMAL(10, 3)", "action": f"{of}action"}
    note = said(R.TIE_BREAK[lang].replace("{margin}", "1.25"), {})
    return f"{said(R.LANGUAGES[lang], fields)} || CASE WHEN {of}by_hierarchy = 1 THEN {note} ELSE '' END"


@query(
    "r5_decide",
    with_frames(
        _REMAP + _SAFE + _RESOLVED + _DECIDED
        + " SELECT decided.*, " + ", ".join(f"{rationale_sql(lang)} AS rationale_{lang}" for lang in R.LANGUAGES)
        + ", coalesce((SELECT string_agg(p.driver, ',' ORDER BY p.value DESC, p.driver) FROM pos p WHERE p.pid = decided.pid), '') AS candidates FROM decided",
        "attributions",
    ),
)
def _(z):
    texts = [F.col("rationale")[lang].alias(f"rationale_{lang}") for lang in R.LANGUAGES]
    return decided(z).select(*_PLAIN, *texts, F.array_join("candidates", ",").alias("candidates"))


@query("r6_days_to_break", with_frames(" SELECT pid, round((1 - risk) * 180, 6) AS days FROM scores", "scores"))
def _(z):
    return z.scores().select("pid", F.round(R.days_to_break(F.col("risk")), 6).alias("days"))


@query("r7_priority_score", with_frames(WORKLIST_SQL + " SELECT pid, role, score FROM worklist", *WORKLIST_FRAMES))
def _(z):
    return worklist(z).select("pid", "role", "score")


_WORK = ["pid", "role", "driver", "score", "needs_review", "rank_in_role", "effective_cap", "expanded", "included"]


@query("r8_build_worklist", with_frames(WORKLIST_SQL + f" SELECT {', '.join(_WORK)} FROM worklist", *WORKLIST_FRAMES))
def _(z):
    return worklist(z).select(*_WORK)


def _entries(m: str):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


@query(
    "r8_worklist_meta",
    with_frames(
        WORKLIST_SQL + """, m AS (SELECT role, count(*) AS n, sum(included) AS taken, max(effective_cap) AS used FROM worklist GROUP BY role)
        SELECT sum(n)::BIGINT AS cohort_size, sum(taken)::BIGINT AS n_taken, sum(used)::BIGINT AS capacity, coalesce(string_agg(role || ':' || used, ',' ORDER BY role) FILTER (used IS NOT NULL), '') AS caps_used,
        coalesce(string_agg(role || ':' || (used - coalesce(cap, n)), ',' ORDER BY role) FILTER (used > coalesce(cap, n)), '') AS expansions, 1 AS rules_version FROM m LEFT JOIN caps USING (role)""",
        *WORKLIST_FRAMES,
    ),
)
def _(z):
    meta = R.worklist_meta(worklist(z), _caps(z))
    return meta.withColumns({c: _entries(c) for c in ("caps_used", "expansions")})


def labelled_sql(column: str, labels: dict, lang: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {said(v[lang], {})}" for k, v in labels.items()) + f" ELSE {column} END"


@query("r8_card_labels", with_frames(WORKLIST_SQL + " SELECT pid, action, " + ", ".join(f"{labelled_sql('action', R.ACTION_LABELS, lang)} AS label_{lang}" for lang in R.LANGUAGES) + " FROM worklist WHERE included = 1", *WORKLIST_FRAMES))
def _(z):
    return worklist(z).where("included = 1").select("pid", "action", *(R.labels_of(F.col("action"), R.ACTION_LABELS, lang).alias(f"label_{lang}") for lang in R.LANGUAGES))


@query("a19_pool_summary", with_frames(WORKLIST_SQL + " SELECT coalesce(action, 'total') AS action, count(*) AS n FROM worklist GROUP BY ROLLUP (action)", *WORKLIST_FRAMES))
def _(z):
    return R.pool_summary(worklist(z))


# ---- windows ------------------------------------------------------------------------------------


@query("w2_rank_in_role", with_frames(WORKLIST_SQL + " SELECT pid, role, rank_in_role FROM worklist", *WORKLIST_FRAMES))
def _(z):
    return worklist(z).select("pid", "role", "rank_in_role")


@query("w3_apply_caps", with_frames(WORKLIST_SQL + " SELECT role, max(effective_cap) AS cap, max(expanded) AS expanded, sum(included)::BIGINT AS n FROM worklist GROUP BY role", *WORKLIST_FRAMES))
def _(z):
    return worklist(z).groupBy("role").agg(F.max("effective_cap").alias("cap"), F.max("expanded").alias("expanded"), F.sum("included").alias("n"))


_SPLIT = """, s AS (SELECT pid, index_date, row_number() OVER (ORDER BY index_date, pid) AS p, count(*) OVER () AS n FROM cohort),
    split AS (SELECT pid, index_date, CASE WHEN p <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN p <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS split FROM s)"""


@query("w4_temporal_split", with_frames(_SPLIT + " SELECT * FROM split", "cohort"))
def _split(z):
    return W.temporal_split(z.cohort())


@query(
    "w5_temporal_leaks",
    with_frames(
        _SPLIT + """, e AS (SELECT split, min(index_date) AS lo, max(index_date) AS hi FROM (SELECT * REPLACE (CASE WHEN pid % 50 = 0 THEN 'train' ELSE split END AS split) FROM split) GROUP BY split)
        SELECT a.split AS earlier, b.split AS later FROM e a JOIN e b ON a.split || '<' || b.split IN ('train<validation', 'validation<test', 'train<test') AND a.hi > b.lo""",
        "cohort",
    ),
)
def _(z):
    return W.temporal_leaks(_split(z).withColumn("split", F.when(F.col("pid") % 50 == 0, "train").otherwise(F.col("split"))))


_FOLDS = ", folds AS (SELECT *, ((row_number() OVER (PARTITION BY event ORDER BY md5(pid::VARCHAR || '|42'), pid) - 1) % 5)::INT AS fold FROM scores)"


@query("w6_stratified_folds", with_frames(_FOLDS + " SELECT pid, event, fold FROM folds", "scores"))
def _(z):
    return W.stratified_folds(z.scores()).select("pid", "event", "fold")


@query("w7_rank_drivers", with_frames(" SELECT *, row_number() OVER (PARTITION BY pid ORDER BY value DESC, driver) AS driver_rank FROM attributions WHERE value > 0 AND driver IN ('access', 'cost', 'isolation', 'bp_trend')", "attributions"))
def _(z):
    return W.rank_drivers(z.attributions(), MODIFIABLE)


@query("w8_incremental_batches", with_frames(" SELECT pid, ((row_number() OVER (ORDER BY md5(pid::VARCHAR || '|7'), pid) - 1) // 25)::INT AS batch FROM subjects", "subjects"))
def _(z):
    return W.incremental_batches(z.subjects(), 25)


# ---- evaluation ---------------------------------------------------------------------------------


def _auc_sql(by: str, source: str) -> str:
    return f""", pairs AS (SELECT {by} AS g, risk, event, rank() OVER w + (count(*) OVER (PARTITION BY {by}, risk) - 1) / 2.0 AS r FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY risk)),
    auc AS (SELECT g, count(*) AS n, sum(event)::BIGINT AS n_events, round((sum(r) FILTER (event = 1) - sum(event) * (sum(event) + 1) / 2.0) / nullif(sum(event) * sum(1 - event), 0), 6)::DOUBLE AS auc FROM pairs GROUP BY g)"""


@query("e1_roc_auc", with_frames(_auc_sql("stratum", "scores") + " SELECT g AS stratum, n, n_events, auc FROM auc", "scores"))
def _(z):
    return E.roc_auc(z.scores(), "stratum")


@query(
    "e2_average_precision",
    with_frames(
        """, s AS (SELECT stratum, risk, sum(event) AS pos, count(*) AS n FROM scores GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY stratum ORDER BY risk DESC)),
        t AS (SELECT stratum, sum(pos * hits / seen) / nullif(sum(pos), 0) AS ap, sum(pos) / sum(n) AS base FROM c GROUP BY stratum)
        SELECT stratum, round(ap, 6) AS average_precision, round(base, 6) AS baseline, round(ap / nullif(base, 0), 6) AS lift FROM t""",
        "scores",
    ),
)
def _(z):
    return E.average_precision(z.scores(), "stratum")


@query(
    "e3_f1_at",
    with_frames(
        _FOLDS + """, c AS (SELECT fold, count(*) FILTER (risk >= 0.35 AND event = 1) AS tp, count(*) FILTER (risk >= 0.35 AND event = 0) AS fp, count(*) FILTER (risk < 0.35 AND event = 1) AS fn FROM folds GROUP BY fold)
        SELECT round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM (SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)""",
        "scores",
    ),
)
def _(z):
    return E.f1_at(W.stratified_folds(z.scores()))


@query(
    "e4_auc_by_group",
    with_frames(_auc_sql("stratum", "scores") + " SELECT g AS stratum, n, n_events, CASE WHEN n >= 50 THEN auc END AS auc, CASE WHEN n < 50 THEN 'n<50' WHEN auc IS NULL THEN 'single-class slice' END AS note FROM auc", "scores"),
)
def _(z):
    return E.auc_by_group(z.scores(), "stratum")


def _c_sql(by: str, source: str) -> str:
    return f""", ci AS (SELECT a.{by} AS g, round((sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*))::DOUBLE, 6) AS c_index
        FROM {source} a JOIN {source} b ON a.{by} = b.{by} AND a.pid <> b.pid AND a.event = 1 AND (a.time < b.time OR b.event = 0) GROUP BY a.{by})"""


@query("e5_c_index", with_frames(_c_sql("stratum", "scores") + " SELECT g AS stratum, c_index FROM ci", "scores"))
def _(z):
    return E.c_index(z.scores(), "stratum")


@query(
    "e6_calibration_report",
    with_frames(
        ", each AS (SELECT pid, risk, event, time, unnest(['overall', stratum]) AS grp FROM scores)" + _auc_sql("grp", "each") + _c_sql("grp", "each")
        + ' SELECT g AS "group", n, n_events, c_index, auc, (n >= 30 AND n_events > 0 AND n_events < n)::INT AS reliable FROM auc LEFT JOIN ci USING (g)',
        "scores",
    ),
)
def _(z):
    return E.calibration_report(z.scores(), "stratum")


@query(
    "e7_selection_parity",
    with_frames(
        WORKLIST_SQL + """, r AS (SELECT stratum, count(*) AS eligible_n, sum(included)::BIGINT AS capped_n, sum(included) / count(*) AS rate FROM worklist GROUP BY stratum),
        m AS (SELECT coalesce(min(rate) / nullif(max(rate), 0), 1.0) AS ratio FROM r) SELECT stratum, eligible_n, capped_n, round(rate, 6) AS rate, round(ratio, 6) AS min_max_ratio, (ratio < 0.8)::INT AS flagged FROM r, m""",
        *WORKLIST_FRAMES,
    ),
)
def _(z):
    cards = worklist(z)
    return E.selection_parity(cards.select("pid", "stratum"), cards.where("included = 1"), "stratum")


@query("e8_action_distribution", with_frames(WORKLIST_SQL + " SELECT stratum, action, round(count(*) / sum(count(*)) OVER (PARTITION BY stratum), 6) AS share FROM worklist WHERE included = 1 GROUP BY stratum, action", *WORKLIST_FRAMES))
def _(z):
    return E.action_distribution(worklist(z).where("included = 1"), "stratum")


@query(
    "e9_stratify",
    with_frames(
        """, f AS (SELECT stratum, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM scores GROUP BY stratum), k AS (SELECT DISTINCT stratum FROM scores UNION ALL SELECT 'UNSEEN')
        SELECT stratum, coalesce(n, 0) AS n, CASE WHEN n >= 15 THEN mean_risk END AS mean_risk, CASE WHEN n >= 15 THEN 'ok' ELSE 'insufficient_sample' END AS status FROM k LEFT JOIN f USING (stratum)""",
        "scores",
    ),
)
def _(z):
    known = z.scores().select("stratum").distinct().union(z.spark.createDataFrame([("UNSEEN",)], "stratum string"))
    return E.stratify(z.scores(), "stratum", known, {"mean_risk": F.round(F.avg("risk"), 6)})


def _dynamic_sql(train: str, rows: str) -> str:
    """Product-limit curves as sums of logarithms over all earlier steps; every case against every control."""
    return f""", tc AS (SELECT time, count(*) AS n, sum(event) AS ev FROM {train} GROUP BY time), tr AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM tc),
        cl AS (SELECT time, CASE WHEN n > ev THEN ln(1 - (n - ev) / (at_risk - ev)) ELSE 0 END AS l FROM tr),
        cg AS (SELECT t.time, exp(coalesce(sum(l), 0)) AS g FROM (SELECT DISTINCT time FROM {rows}) t LEFT JOIN cl ON cl.time <= t.time GROUP BY t.time),
        vc AS (SELECT time, count(*) AS n, sum(event) AS ev FROM {rows} GROUP BY time), vr AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM vc),
        h AS (SELECT unnest([45.0, 90.0, 135.0])::DOUBLE AS horizon), sv AS (SELECT horizon, exp(coalesce(sum(ln(1 - ev / at_risk)), 0)) AS s FROM h LEFT JOIN vr ON time <= horizon GROUP BY horizon),
        e AS (SELECT r.*, g, horizon FROM {rows} r JOIN cg USING (time) CROSS JOIN h), a AS (SELECT horizon, risk, 1 / g AS w FROM e WHERE time <= horizon AND event = 1), b AS (SELECT horizon, risk FROM e WHERE time > horizon),
        au AS (SELECT a.horizon, sum(CASE WHEN a.risk > b.risk THEN w WHEN a.risk = b.risk THEN w / 2 ELSE 0 END) / sum(w) AS auc FROM a JOIN b ON a.horizon = b.horizon GROUP BY a.horizon),
        al AS (SELECT horizon, auc, s, lag(s, 1, 1.0) OVER (ORDER BY horizon) - s AS lost FROM au JOIN sv USING (horizon))
        SELECT horizon, round(auc, 6) AS auc, round((SELECT sum(auc * lost) / (1 - min(s)) FROM al), 6) AS mean_auc FROM al"""


@query("e10_dynamic_auc", with_frames(_dynamic_sql("scores", "scores"), "scores"))
def _(z):
    return E.dynamic_auc(z.scores(), [45.0, 90.0, 135.0])


_SIDES = ", later AS (SELECT * FROM scores WHERE stratum IN ('BUILDING', 'MACHINERY')), earlier AS (SELECT * FROM scores WHERE stratum NOT IN ('BUILDING', 'MACHINERY'))"


@query("e10_dynamic_auc_of_training_set", with_frames(_SIDES + _dynamic_sql("earlier", "later"), "scores"))
def _(z):
    later = F.col("stratum").isin("BUILDING", "MACHINERY")
    return E.dynamic_auc(z.scores().where(later), [45.0, 90.0, 135.0], z.scores().where(~later))


@query("e11_time_quantiles", with_frames(" SELECT DISTINCT unnest(quantile_cont(time::DOUBLE, [0.25, 0.5, 0.75])) AS horizon FROM scores WHERE time < (SELECT max(time) FROM scores)", "scores"))
def _(z):
    return E.time_quantiles(z.scores())


@query(
    "m7_linear_attribution",
    with_frames(" SELECT pid, round(0.8 * ((risk - 0.5) / 0.3 - (SELECT avg((risk - 0.5) / 0.3) FROM scores)), 6) AS risk_attr, round(-0.4 * ((time - 90) / 50.0 - (SELECT avg((time - 90) / 50.0) FROM scores)), 6) AS time_attr FROM scores", "scores"),
)
def _(z):
    from ..operators.attribution import linear_attribution

    out = linear_attribution(z.scores(), {"risk": 0.8, "time": -0.4}, {"risk": (0.5, 0.3), "time": (90, 50.0)})
    return out.select("pid", F.round("risk_attr", 6).alias("risk_attr"), F.round("time_attr", 6).alias("time_attr"))


@query("m9_drivers_from_features", with_frames(" SELECT pid, CASE WHEN driver IN ('access', 'cost') THEN 'barrier' ELSE 'clinical' END AS driver, round(sum(value), 6) AS value, max(raw) AS raw FROM attributions GROUP BY ALL", "attributions"))
def _(z):
    from ..operators.attribution import drivers_from_features

    names = z.spark.createDataFrame([(f, "barrier" if f in ("access", "cost") else "clinical") for f in ("access", "cost", "isolation", "regimen", "bp_trend", "safety")], "feature string, driver string")
    return drivers_from_features(z.attributions().withColumnRenamed("driver", "feature"), names).withColumn("value", F.round("value", 6))
