"""Every registered query of the library against its SQL, on the smallest tables.  The queries without SQL have tests of their own."""

from pathlib import Path

import pytest
from ledgerloom.plans.catalog import ORACLE, QUERIES
from oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows_with_distinct_columns(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len({c.lower() for c in df.columns}) == len(df.columns) and any(v is not None for v in rows[0])


def test_each_query_without_sql_is_recomputed_somewhere():
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    recomputed = {  # the operators behind queries that the tests call by another name
        "a22_basis": "basis_id", "m10_backtest_workload": "backtest_candidates", "m20_cost_observations": "QM._cost", "m21_interval_ridge": "interval_ridge", "m22_cost_evaluation": "cost_evaluation", "m26_uncertainty_diagnostics": "uncertainty_diagnostics",
        "m27_regime_report": "regime_report", "m28_composed_evaluation": "composed_evaluation", "m29_assess_selection": "assess_selection", "m33_scenario_estimate": "scenario_estimate", "m3_m4_calibration": "calibration_errors", "m40_threshold_study": "threshold_study",
        "m43_rolling_joint_comparison": "rolling_joint_comparison", "m44_transfer_evaluation": "transfer_evaluation", "m45_aligned_window_study": "aligned_window_study", "m46_tt_evaluation": "tt_evaluation", "m47_session_quota_evaluation": "session_quota_evaluation",
        "m50_crossing_windows": "crossing_outcomes", "m7_horizon_predictions": "horizon_predictions", "m9_workload_correction": "workload_correction", "w11_evidence_support": "evidence_support", "w22_change_point": "change_point",
    }
    for name in set(QUERIES) - set(ORACLE):
        assert recomputed.get(name, f'"{name}"') in tests, name
