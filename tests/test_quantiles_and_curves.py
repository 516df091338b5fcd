"""Exact quantiles in passes, and time-dependent AUC, against plain versions."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from refillspark.operators import evaluation as E  # noqa: E402
from refillspark.operators import models as M  # noqa: E402
from refillspark.operators.distributed import order_statistics, quantiles  # noqa: E402


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_quantiles_equal_the_sorted_ones(spark, most):
    rng = random.Random(most)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "skewed": [10.0 ** rng.uniform(-300, 300) for _ in range(3000)],
        "tied": [float(rng.choice((0, 0, 0, 1, 1, 2))) for _ in range(3000)],
        "same": [7.0] * 3000,
        "gaps": [None if rng.random() < 0.7 else float(rng.randint(-5, 5)) for _ in range(3000)],
        "one": [4.0] + [None] * 2999,
        "none": [None] * 3000,
    }
    rows = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(3)
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(rows, list(columns), at, most)
    for c, values in columns.items():
        known = [v for v in values if v is not None]
        assert got[c] == (pytest.approx(np.quantile(known, at).tolist(), rel=1e-12) if known else [None] * len(at))
    assert order_statistics(rows, [("normal", k) for k in (0, 1, 1500, 2999)], most) == [sorted(columns["normal"])[k] for k in (0, 1, 1500, 2999)]
    filled = M.impute_with_indicator(rows, ["gaps", "none"]).agg({"gaps_missing": "sum", "none": "max"}).first()
    assert filled["sum(gaps_missing)"] == columns["gaps"].count(None) and filled["max(none)"] == 0
    assert quantiles(rows.limit(0), ["normal"], [0.5]) == {"normal": [None]}


def test_horizons_are_quantiles_below_the_longest_time(spark):
    rows = spark.createDataFrame([(t,) for t in (1, 2, 3, 4, 10, 10, 10)], "time int")
    assert sorted(r.horizon for r in E.time_quantiles(rows).collect()) == [1.75, 2.5, 3.25]
    assert E.time_quantiles(spark.createDataFrame([(5,), (5,)], "time int")).count() == 0


def plain_auc(rows, horizons, train):
    def curve(data, at, censoring):
        s = 1.0
        for t in sorted({x[0] for x in data if x[0] <= at}):
            risk = sum(x[0] >= t for x in data)
            ev = sum(x[0] == t and x[1] == 1 for x in data)
            goes, of = (sum(x[0] == t for x in data) - ev, risk - ev) if censoring else (ev, risk)
            if goes:
                s *= 1 - goes / of
        return s

    out, kept = {}, [curve(rows, h, False) for h in horizons]
    for h in horizons:
        cases = [(r, curve(train, t, True)) for t, e, r in rows if t <= h and e]
        controls = [r for t, _, r in rows if t > h]
        if not cases or not controls or any(g <= 0 for _, g in cases):
            out[h] = None
        else:
            out[h] = sum((a > b) / g + (a == b) / 2 / g for a, g in cases for b in controls) / sum(1 / g for _, g in cases) / len(controls)
    mean = None
    if all(v is not None for v in out.values()):
        lost = -np.diff([1.0, *kept])
        mean = float((np.array(list(out.values())) * lost).sum() / (1 - kept[-1])) if len(horizons) > 1 else out[horizons[0]]
    return out, mean


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dynamic_auc_weighs_by_a_training_set(spark, seed):
    rng = random.Random(seed)
    make = lambda n, top: [(rng.choice((rng.randint(1, top), rng.uniform(1, top))), int(rng.random() < 0.5), round(rng.random(), 1)) for _ in range(n)]
    train, rows = [(float(t), e, r) for t, e, r in make(150, 40)] + [(60.0, 1, 0.0)], [(float(t), e, r) for t, e, r in make(90, 50)]
    shape = "time double, event int, risk double"
    frames = [spark.createDataFrame(x, shape) for x in (rows, train)]
    for horizons in ([10.0, 20.0, 35.0], [17.5]):
        want, mean = plain_auc(rows, horizons, train)
        got = {r.horizon: (r.auc, r.mean_auc) for r in E.dynamic_auc(frames[0], horizons, frames[1]).collect()}
        assert got == {h: (pytest.approx(a, abs=2e-6), pytest.approx(mean, abs=2e-6)) for h, a in want.items()}
        assert plain_auc(rows, horizons, rows)[0] != want
    own, mean = plain_auc(rows, [20.0], rows)
    assert [(r.auc, r.mean_auc) for r in E.dynamic_auc(frames[0], [20.0]).collect()] == [(pytest.approx(own[20.0], abs=2e-6), pytest.approx(mean, abs=2e-6))]


def test_auc_without_a_chance_or_cases_is_null(spark):
    shape = "time double, event int, risk double"
    rows = spark.createDataFrame([(5.0, 1, 0.9), (9.0, 0, 0.1), (12.0, 1, 0.2)], shape)
    train = spark.createDataFrame([(1.0, 1, 0.0), (4.0, 0, 0.0)], shape)  # everyone is censored by day 4
    assert [(r.horizon, r.auc, r.mean_auc) for r in E.dynamic_auc(rows, [6.0, 2.0], train).orderBy("horizon").collect()] == [(2.0, None, None), (6.0, None, None)]
    assert [r.auc for r in E.dynamic_auc(rows, [6.0]).collect()] == [1.0]


def plain_c_index(rows):
    good = pairs = 0
    for a in rows:
        for b in rows:
            if a[3] == 1 and (b[3] == 0 or b[2] > a[2]):
                pairs += 1
                good += 1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0
    return round(good / pairs, 6) if pairs else None


@pytest.mark.parametrize("most", [5, 30, None])
@pytest.mark.parametrize("kind", ["continuous", "skewed", "tied"])
def test_concordance_over_stripes(spark, kind, most):
    rng = random.Random(7)
    score = {"continuous": rng.random, "skewed": lambda: 10.0 ** rng.uniform(-200, 0), "tied": lambda: rng.choice((0.2, 0.2, 0.2, 0.7, rng.random()))}[kind]
    time = {"continuous": lambda: rng.uniform(1, 90), "skewed": lambda: 2.0 ** rng.uniform(-60, 20), "tied": lambda: float(rng.choice((5, 5, 5, 9, rng.randint(1, 30))))}[kind]
    rows = [(g, score(), time(), int(rng.random() < 0.7)) for g in ("a", "b", None) for _ in range(150)] + [("one", 0.5, 3.0, 1)]
    got = {r.g: r.c_index for r in E.c_index(spark.createDataFrame(rows, "g string, risk double, time double, event int"), "g", most=most).collect()}
    assert got == {g: plain_c_index([r for r in rows if r[0] == g]) for g in ("a", "b", None, "one")}


@pytest.mark.parametrize("kind", ["skewed", "tied"])
def test_stripes_are_bounded_and_in_order(spark, kind):
    rng = random.Random(3)
    value = {"skewed": lambda: 10.0 ** rng.uniform(-250, 250), "tied": lambda: rng.choice((1.0, 1.0, 1.0, 2.0, rng.random()))}[kind]
    rows = [("a" if i % 3 else None, value()) for i in range(2000)]
    found = E._striped(spark.createDataFrame(rows, "g string, r double"), "r", "rc", 20).collect()
    assert len(found) == 2000
    for g in ("a", None):
        own = sorted((r.r, r.rc) for r in found if r.g == g)
        assert [rc for _, rc in own] == sorted(rc for _, rc in own)
        stripes = {}
        for r, rc in own:
            stripes.setdefault(rc, []).append(r)
        assert all(len(v) <= 20 or len(set(v)) == 1 for v in stripes.values()) and len(stripes) > 20
