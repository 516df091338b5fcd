"""Rows dealt by key, and parts that are stored so that no task sorts several of them at once."""

import pytest

from refillspark.operators.distributed import dealt
from refillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_parts_grow_with_the_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "pid")
    assert dealt(rows, "pid", 1000, 250).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert [dealt(rows, "pid", n, 10).rdd.getNumPartitions() for n in (1000, 2001)] == [100, 201]
    assert sorted(r.pid for r in dealt(rows, "pid", 1000, 10).collect()) == list(range(1000))


# m1 worked its means out anew in each pass; F19-F22: one stage sorted the rows of all parts.
@pytest.mark.parametrize("name", ["m1_impute_with_indicator", "j11_assemble_panel", "j12_labelled_frame", "j13_select_feature_columns", "a17_group_profile"])
def test_results_come_from_stored_parts(spark, name):
    assert not [f for f in catalogue.queries()[name](spark, SF).inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f and name == "m1_impute_with_indicator"]


# F3-F17: each part of the models' panel is stored before they are joined.
def test_panel_joins_stored_parts(spark, monkeypatch):
    from refillspark.plans import modelling
    from refillspark.plans.lens import Lens

    stored, real = [], modelling.T.kept
    monkeypatch.setattr(modelling.T, "kept", lambda df, what: stored.append((what, df.inputFiles())) or real(df, what))
    modelling._panel(Lens(spark, SF))
    assert [w for w, _ in stored] == ["part"] * 6 + ["panel"]
    assert not [f for f in stored[-1][1] if "lineitem.parquet" in f]


# F4-F21: parts of a shuffle were merged by compressed bytes, so a task's sort of fills or lines grew with the input.
def test_events_are_dealt_in_parts_of_bounded_rows(spark, monkeypatch):
    from functools import partial

    from refillspark.plans import lens

    monkeypatch.setattr(lens, "dealt", partial(dealt, each=100))
    z = lens.Lens(spark, SF)
    orders, lines = (-(-z.table(t).count() // 100) for t in ("orders", "lineitem"))
    assert {f.rdd.getNumPartitions() for f in (z.fills(), z.encounters(), z.payers())} == {orders} and orders > 4
    assert {f.rdd.getNumPartitions() for f in (z.observations(), z.conditions())} == {lines}
    monkeypatch.setattr(lens, "dealt", partial(dealt, each=20))
    assert z.rows_by_subject(z.cohort()).rdd.getNumPartitions() == -(-z.table("customer").count() // 20) > 4
    assert z._lines()._jdf.queryExecution().toString().count("RepartitionByExpression [l_orderkey") > 0


# F5-F15: each stage of the panel worked the cohort out anew beside its own sorts.
def test_parts_of_the_panel_share_one_stored_cohort(spark, monkeypatch):
    from refillspark.plans import modelling
    from refillspark.plans.lens import Lens

    read, real = [], modelling.T.kept
    monkeypatch.setattr(modelling.T, "kept", lambda df, what: read.append(df.inputFiles()) or real(df, what))
    z = Lens(spark, SF)
    modelling._panel(z)
    cohorts = {f.rsplit("/", 2)[1] for files in read for f in files if "/cohort-" in f}
    assert len(cohorts) == 1 and all(any("/cohort-" in f for f in files) for files in read)
    assert sorted(z.with_stored_cohort().cohort().collect()) == sorted(z.cohort().collect())


# F6-F14: the panel's largest task sorted visits and readings, each beside its own copy of the cohort.
def test_visits_and_readings_are_stored_before_they_are_joined(spark):
    from refillspark.plans import features
    from refillspark.plans.lens import Lens

    plan = features.engagement(Lens(spark, SF).with_stored_cohort())
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in plan.inputFiles()} == {"cohort", "visits", "readings"}
