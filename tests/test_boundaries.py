"""Boundaries of the leakage rule, coverage arithmetic, consent, escalation and models on small frames."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from refillspark import functions as S
from refillspark import sources
from refillspark.operators import cohort as C
from refillspark.operators import consent as N
from refillspark.operators import coverage as V
from refillspark.operators import escalation as X
from refillspark.operators import evaluation as E
from refillspark.operators import features as A
from refillspark.operators import models as M
from refillspark.operators import routing as R
from refillspark.operators import windows as W

INDEX = date(2025, 6, 1)


def cohort(spark):
    return spark.createDataFrame([(1, INDEX)], "pid long, index_date date")


def days(n):
    return INDEX + timedelta(days=n)


def test_only_rows_before_the_index_count(spark):
    rows = spark.createDataFrame([(1, "A", days(-1), 120.0), (1, "A", days(0), 999.0), (1, "A", days(1), 999.0), (1, "A", None, 999.0)], "pid long, code string, date date, value double")
    [r] = A.trajectory(rows, cohort(spark), {"sbp": "A"}).collect()
    assert (r.sbp_mean, r.sbp_max, r.sbp_latest_reading, r.sbp_trajectory_slope) == (120.0, 120.0, 120.0, None)


def test_coverage_counts_overlaps_once_and_sees_all_gaps(spark):
    fills = spark.createDataFrame(
        [(1, "x", days(10), days(40)), (1, "x", days(20), days(50)), (1, "x", days(100), days(170)), (1, "x", days(-5), days(30)), (2, "x", days(0), days(1))],
        "pid long, code string, start date, stop date",
    )
    swept = V.sweep(C.forward_window_intervals(fills, cohort(spark)), cohort(spark))
    [r] = swept.collect()
    assert (r.covered_days, r.max_gap) == (50 + 70, 50)
    nobody = V.sweep(C.forward_window_intervals(fills.where("pid = 9"), cohort(spark)), cohort(spark))
    [r] = V.gap_flag(nobody).collect()
    assert (r.max_gap, r.has_30_day_gap) == (180, 1)


def test_sweep_equals_counting_days(spark):
    import random

    rng = random.Random(5)
    rows = [(p, "x", days(rng.randint(-40, 200)), days(rng.randint(-40, 260))) for p in range(40) for _ in range(rng.randint(0, 6))]
    people = spark.createDataFrame([(p, INDEX) for p in range(40)], "pid long, index_date date")
    found = {r.pid: (r.covered_days, r.max_gap) for r in V.sweep(C.forward_window_intervals(spark.createDataFrame(rows, "pid long, code string, start date, stop date"), people), people).collect()}
    for p in range(40):
        had = [False] * 180
        for q, _, a, b in rows:
            if q == p:
                b = b if b > a else a + timedelta(days=30)
                for d in range(180):
                    had[d] |= a <= days(d) < b
        gap = longest = 0
        for h in had:
            gap = 0 if h else gap + 1
            longest = max(longest, gap)
        assert found[p] == (sum(had), longest)


def test_refill_gap_arithmetic(spark):
    starts = (-200, -169, -109)
    fills = spark.createDataFrame([(1, "other", days(d), None, i, 100.0, 70.0) for i, d in enumerate(starts)], "pid long, code string, start date, stop date, encounter long, total double, covered double")
    [r] = A.refill_gaps(fills, cohort(spark), ["index"]).collect()
    assert (r.xdrug_refill_gap_mean, r.xdrug_refill_gap_max) == (45.5, 60)
    [r] = A.cross_drug_profile(fills, cohort(spark), ["index"]).collect()
    assert (r.xdrug_oop_cost_mean, r.xdrug_tenure_days, r.xdrug_days_since_last_fill) == (30.0, 200, 109)


@pytest.mark.parametrize("offsets, flag", [([-10], 0), ([-10, -20], 1), ([-500, -600], 0), ([-10, -10], 0), ([1, 2], 0)])
def test_strict_flag(spark, offsets, flag):
    rows = spark.createDataFrame([(1, "c", days(d)) for d in offsets], "pid long, code string, start date")
    assert A.strict_flag(rows, cohort(spark), ["c"], "x").first()["flag_x"] == flag


def test_tolerant_functions_and_buckets(spark):
    import hashlib

    [r] = spark.range(1).select(S.to_number(F.lit("x")).alias("a"), S.to_number(F.lit("NaN")).alias("n"), S.parse_day(F.lit("2024-02-30")).alias("b"), S.hash_bucket(F.lit("p-17")).alias("c"), S.elapsed_days(F.lit("2024-01-02 00:00:00"), F.lit("2024-01-01 12:00:00")).alias("d")).collect()
    assert (r.a, r.n, r.b, r.c, r.d) == (None, None, None, int(hashlib.sha1(b"p-17").hexdigest(), 16) % 100, -1)


def test_outcomes_never_become_features(spark):
    panel = spark.createDataFrame([(1, 2.0, 0.5, 1, "x")], "pid long, sbp_mean double, pdc_180d double, has_30_day_gap int, stratum string")
    assert C.select_feature_columns(panel).columns == ["pid", "sbp_mean"]


def test_consent_fails_closed(spark):
    people = spark.createDataFrame([(i,) for i in range(6)], "pid long")
    today = date(2025, 1, 1)
    rows = [(0, "granted", "granted", today), (1, "denied", "denied", today), (2, "unknown", None, today), (3, "granted", "granted", today - timedelta(days=366)), (4, "granted", "granted", None)]
    status = N.consent_status(people, spark.createDataFrame(rows, "pid long, internal string, external string, as_of date"), "2025-01-01")
    acts = people.withColumn("action", F.lit("transit_voucher"))
    reasons = {r.pid: (r.allowed, r.reason) for r in N.gate(acts, status).collect()}
    assert reasons == {0: (1, "authorized"), 1: (0, "denied"), 2: (0, "unknown_not_received"), 3: (0, "stale_consent"), 4: (0, "stale_consent"), 5: (0, "unknown_not_received")}
    assert {r.reason for r in N.gate(people.withColumn("action", F.lit("shout")), status).collect()} == {"undeclared_action"}


def test_schedule_follows_leads_latency_and_past_breaks(spark):
    cards = spark.createDataFrame([(1, "cost", 0, 170.0, INDEX), (2, "cost", 0, -10.0, INDEX), (3, "cost", 0, 5.0, INDEX)], "pid long, driver string, is_safety int, days_to_break double, entry_date date")
    rows = {r.pid: r for r in X.round_schedule(cards, 14).collect()}
    assert rows[1].wait_0 == days(110) and rows[1].escalate_0 == days(140) and rows[1].effective_0 == days(154) and rows[1].wait_1 == days(154)
    assert rows[2].break_date == INDEX and rows[2].wait_0 == INDEX and rows[2].escalate_0 == days(7) and rows[2].unactionable == 0
    assert rows[3].unactionable == 1


def test_state_is_idempotent_and_dates_freeze(spark):
    cards = spark.createDataFrame([(1, "cost", 0, 5.0), (2, "access", 1, 100.0)], "pid long, driver string, is_safety int, days_to_break double")
    people = cards.select("pid")
    status = N.consent_status(people, spark.createDataFrame([(1, "granted", "granted", INDEX), (2, "granted", "denied", INDEX)], "pid long, internal string, external string, as_of date"), "2025-06-10")
    none = spark.createDataFrame([], "pid long, observed int, on_time_refill int, event_date date")
    first = X.advance_state(cards, none, status, None, "2025-06-01", 0)
    moved = X.advance_state(cards.withColumn("days_to_break", F.lit(90.0)), none, status, first, "2025-06-10", 0)
    again = X.advance_state(cards.withColumn("days_to_break", F.lit(90.0)), none, status, moved, "2025-06-10", 0)
    key = lambda df: sorted((r.pid, str(r.entry_date), r.days_to_break, r.round, r.status, tuple(sorted((n, str(d)) for n, d in r.dispatch_dates.items()))) for r in df.collect())
    assert key(moved) == key(again)
    assert {r[0]: r[5] for r in key(moved)} == {1: ((0, "2025-06-01"), (1, "2025-06-10")), 2: ((1, "2025-06-01"),)}
    assert {r[0]: r[1:3] for r in key(moved)} == {1: ("2025-06-01", 5.0), 2: ("2025-06-01", 100.0)}
    funnel = {(r.measure, r.key): r.n for r in X.escalation_funnel(moved).collect()}
    assert sum(n for (m, _), n in funnel.items() if m == "status") == sum(n for (m, _), n in funnel.items() if m == "round") == funnel[("total", "all")] == 2


def test_messages_go_to_providers_in_four_languages(spark):
    cards = spark.createDataFrame([(1, "access", 0, 0.0, date(2024, 1, 1))], "pid long, driver string, is_safety int, days_to_break double, entry_date date")
    people = cards.select("pid")
    status = N.consent_status(people, spark.createDataFrame([(1, "granted", "denied", date(2024, 12, 1))], "pid long, internal string, external string, as_of date"), "2025-01-01")
    none = spark.createDataFrame([], "pid long, observed int, on_time_refill int, event_date date")
    rounds = X.round_rows(X.escalation_status(X.round_schedule(cards, 0), none, status, "2025-01-01"), status)
    messages = X.dispatch_messages(rounds).collect()
    assert {m.lang for m in messages} == {"en", "es", "pt", "ht"} and {m.addressed_to for m in messages} == {"provider_or_organization"}
    assert [(g["round"], g.fallback_action) for g in X.gated_actions(rounds).collect()] == [(1, "chw_transport_support")]
    last = [m.body for m in messages if m.round == 2 and m.lang == "en"][0]
    assert "Round 0 (community health worker) - " in last and "Round 1 (community health worker) - " in last
    by = {(m["round"], m.lang): m for m in messages}
    assert [(by[r, "en"].recipient, by[r, "en"].kind, by[r, "en"].mediated_by) for r in range(3)] == [("ae_chw", "chw_pharmacy", "pharmacy"), ("ae_chw", "chw_transport_fallback", "internal_transportation"), ("prescriber", "prescriber", None)]
    assert all(X.NO_HISTORY[lang] in by[0, lang].body and by[0, lang].read_aloud for lang in X.MESSAGES)
    waiting = X.round_rows(X.escalation_status(X.round_schedule(cards.withColumn("entry_date", F.lit(date(2024, 12, 30))), 0), none, status, "2025-01-01"), status).collect()
    assert [(r["round"], r.outcome, r.dispatched_on) for r in waiting] == [(0, "pending", None)]  # pending: not sent yet


def test_routing_beside_the_hierarchy_and_faults_of_rules(spark):
    from refillspark.operators import routing as R

    rules = spark.createDataFrame([("a", "chw_call", None, None), ("b", "fax", None, None), ("bp_trend", "pharmacist", None, 1)], "driver string, action string, secondary_action string, hierarchy int")
    given = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.9), (2, "a", -1.0)], "pid long, driver string, value double")
    assert {r.pid: (r.driver, r.value, r.by_hierarchy) for r in R.resolve_driver(given, rules).collect()} == {1: ("a", 1.0, 1), 2: ("bp_trend", 0.0, 1)}
    faults = R.validate_rules(rules, hierarchy=spark.createDataFrame([("a",), ("zzz",)], "driver string")).collect()
    assert sorted((r.driver, r.fault) for r in faults) == [("b", "unknown_action"), ("zzz", "unknown_driver")]


def test_auc_handles_ties_and_single_classes(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.3, 1)], "g string, risk double, event int")
    found = {r.g: r.auc for r in E.roc_auc(rows, "g").collect()}
    assert found == {"a": 0.875, "b": None}


def test_caps_widen_for_reviews(spark):
    cards = spark.createDataFrame([(i, "sw", int(i < 3), float(i)) for i in range(6)] + [(9, "free", 0, 1.0)], "pid long, role string, needs_review int, score double")
    out = {r.pid: (r.effective_cap, r.expanded, r.included) for r in W.apply_caps(W.rank_in_role(cards), spark.createDataFrame([("sw", 2)], "role string, cap int")).collect()}
    assert [p for p, v in out.items() if v[2]] and sorted(p for p, v in out.items() if v[2]) == [0, 1, 2, 9] and out[0][:2] == (3, 1) and out[9][:2] == (1, 0)
    assert [out[p][1] for p in range(6)] == [1, 1, 1, 0, 0, 0]  # only those for review are marked


def test_split_fractions_are_checked(spark):
    with pytest.raises(ValueError):
        W.temporal_split(cohort(spark), 0.5, 0.5, 0.5)


def test_rules_with_unknown_actions_are_found(spark):
    bad = spark.createDataFrame([("x", "fly", None, 1)], "driver string, action string, secondary_action string, hierarchy int")
    assert R.validate_rules(R.rules_table(spark)).isEmpty() and R.validate_rules(bad).count() == 1
    assert sources.invalid_profiles(sources.source_profiles(spark)).isEmpty()


def test_tree_attributions_add_up_to_the_margin(spark):
    import random

    rng = random.Random(3)
    rows = [(i, float(a := rng.random()), float(b := rng.random()), float(rng.random()), int(a + b > 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, a double, b double, c double, event int")
    model = M.fit_gbt(df, ["a", "b", "c"], "event", 4, 3)
    explained = M.tree_attribution(df, model, ["a", "b", "c"]).toPandas().set_index("pid")
    from pyspark.ml.functions import vector_to_array

    raw = model.transform(df).select("pid", vector_to_array("rawPrediction")[1].alias("m")).toPandas().set_index("pid").m
    assert (explained.margin - raw).abs().max() < 1e-9
    assert (explained.base + explained[["a_attr", "b_attr", "c_attr"]].sum(axis=1) - explained.margin).abs().max() < 1e-9
    assert explained.a_attr.abs().mean() > explained.c_attr.abs().mean()


def test_tree_attributions_equal_the_sums_over_all_sets():
    from itertools import combinations
    from math import factorial

    import numpy as np

    rng = np.random.default_rng(3)
    for m in (0, 1, 2, 5, 6):
        path = {f: (((0.5, bool(f % 2)), (0.9, True)), float(rng.uniform(0.1, 0.9))) for f in range(m)}
        x = rng.random((20, 7))
        values, base = M._attribute(x, [(path, 3.0)], 7)
        met = {f: ((x[:, f] <= 0.5) == bool(f % 2)) & (x[:, f] <= 0.9) for f in path}
        worth = lambda known: 3.0 * np.prod([met[f] * 1.0 if f in known else np.full(20, path[f][1]) for f in path] or [np.ones(20)], axis=0)
        want = np.zeros((20, 7))
        for f in path:
            others = [g for g in path if g != f]
            for size in range(m):
                for known in combinations(others, size):
                    want[:, f] += factorial(size) * factorial(m - size - 1) / factorial(m) * (worth({*known, f}) - worth(set(known)))
        assert np.abs(values - want).max() < 1e-12 and abs(base - worth(set())[0]) < 1e-12


def test_tree_attribution_of_a_long_path_is_fast():
    import numpy as np

    path = {f: (((0.5, True),), 0.7) for f in range(40)}  # two to the 40 sets
    x = np.random.default_rng(3).random((50, 40))
    values, base = M._attribute(x, [(path, 1.0)], 40)
    assert np.abs(base + values.sum(axis=1) - (x <= 0.5).all(axis=1)).max() < 1e-12


def test_missing_snapshot_and_columns(spark, tmp_path):
    assert sources.read_snapshot(spark, f"{tmp_path}/none", "pid long").count() == 0
    with pytest.raises(FileNotFoundError):
        sources.load_tables(spark, str(tmp_path), {"absent": ["x"]})
    with pytest.raises(ValueError):
        sources.read_claims_fills(spark.range(1), spark.range(1), "2024-01-01", "2024-02-01")
    with pytest.raises(ValueError):
        M.score_holdout(None, spark.createDataFrame([(1,)], "pid long"), ["a"])


def test_concordance_equals_all_pairs(spark):
    import random

    from refillspark.operators import evaluation as E

    rng = random.Random(3)
    rows = [(g, round(rng.random(), 2), rng.choice([0, 1, 1]), float(rng.randrange(1, 90)) + rng.choice([0.0, 0.5])) for g in ("a", "b") for _ in range(300)]
    rows += [("c", 0.5, 1, 7.0)] * 30 + [("c", 0.6, 1, 8.0)] + [("d", 0.5, 1, 7.0), ("e", 0.5, 0, 7.0)]
    got = {r.g: r.c_index for r in E.c_index(spark.createDataFrame(rows, "g string, risk double, event int, time double"), "g").collect()}
    for g in "abcde":
        own = [r for r in rows if r[0] == g]
        pairs = [1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for i, a in enumerate(own) for j, b in enumerate(own) if i != j and a[2] == 1 and (a[3] < b[3] or b[2] == 0)]
        assert got[g] == (round(sum(pairs) / len(pairs), 6) if pairs else None)


def test_days_are_elapsed_days_where_times_are_given(spark):
    from refillspark.operators import features as V2

    at = lambda s: F.to_timestamp(F.lit(s))
    people = spark.range(1).select(F.lit(1).alias("pid"), at("2024-03-10 12:00:00").alias("index_date"))
    seen = spark.range(1).select(F.lit(1).alias("pid"), F.explode(F.array(*(F.struct(at(t).alias("date"), F.lit(v).alias("value")) for t, v in (("2024-03-08 00:00:00", 1.0), ("2024-03-09 12:00:00", 4.0))))).alias("x")).select("pid", F.lit("c").alias("code"), "x.*")
    [r] = V2.trajectory(seen, people, {"bp": "c"}).collect()
    assert r.bp_trajectory_slope == 2.0  # three in a day and a half
    fills = spark.range(1).select(F.lit(1).alias("pid"), F.lit("c").alias("code"), F.explode(F.array(at("2023-01-01 20:00:00"), at("2024-01-02 10:00:00"), at("2025-01-02 09:00:00"))).alias("start"))
    [first] = C.incident_index_date(fills, ["c"], washout=364).collect()
    assert str(first.index_date) == "2023-01-01 20:00:00"
    late = C.incident_index_date(fills.where("start > timestamp '2023-06-01'"), ["c"], washout=366).collect()
    assert len(late) == 1
