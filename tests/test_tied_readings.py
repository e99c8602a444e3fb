"""Readings of one time, as tables have them that repeat others with shifted keys: in the order of their ids, as in the SQL."""

import duckdb
import pytest
from ledgerloom.operators.forecasting import rank_allowances
from ledgerloom.plans.catalog import ORACLE, QUERIES
from oracle import TABLES, differences
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    path = tmp_path_factory.mktemp("repeated")
    for t in TABLES:
        (path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet") if t != "events" else None
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + c * 100000 AS event_id, user_id + c * 1500 AS user_id) FROM '{SF}/events.parquet', range(0, 40) r(c)) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


NAMES = ["w5_split_epochs", "j10_backward_asof", "j9_forward_asof", "m20_cost_candidates", "w12_pace_estimates", "w13_project_remaining", "w14_pace_receipt"]


@pytest.mark.parametrize("name", NAMES)
def test_tied_readings_match_sql(spark, repeated, name):
    assert differences(spark, QUERIES[name], ORACLE[name], repeated) == ""


def test_allowances_that_limit_alike_are_ranked_by_their_readings(spark):
    rows = [("o", a, us, 90.0, 0.0, 5) for a, us in (("x", 2), ("y", 1), ("b", 3), ("a", 3))]
    f = spark.createDataFrame(rows, "owner string, account string, us long, used double, pressure double, resets_us long").withColumn("eta_hours", F.lit(None).cast("double"))
    assert [r.account for r in rank_allowances(f.repartition(3), "owner").orderBy("rank").collect()] == ["y", "x", "a", "b"]
