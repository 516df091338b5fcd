"""Queries whose results depend on the scale (rounding, searches that must hit) against their SQL at sf0.01."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import database, spark_rows, sql_rows  # noqa: E402

from refillspark.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    return database(SF)


@pytest.mark.parametrize(
    "name",
    ["w4_temporal_split", "w5_temporal_leaks", "w2_rank_in_role", "v1_worklist_view", "v7_worklist_filter", "c11_dispatch_messages", "c13_advance_state", "s11_select_source", "v4_source_status", "r1_validate_rules", "r5_decide", "e2_average_precision", "e6_calibration_report", "e10_dynamic_auc", "t4_harvest_labels", "j15_overlay_labels", "t7_stream_escalation", "t7_stream_timers", "t8_latency_counts", "e10_dynamic_auc_of_training_set", "v7_worklist_facets", "w3_apply_caps", "m1_impute_with_indicator", "m2_logistic_properties", "m5_out_of_fold_rows", "m8_tree_attribution_additive", "m10_aft_survival_properties"],
)
def test_query_matches_sql_and_is_not_empty(spark, tables, name):
    columns, rows = spark_rows(catalogue.queries()[name](spark, SF))
    names, expected = sql_rows(tables, catalogue.oracle_sql()[name])
    assert columns == names
    assert rows == expected and rows
