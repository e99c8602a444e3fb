"""J17 reads the large tables once: what its sides share is written by day."""

from ledgerloom.plans.catalog import QUERIES


def test_the_ledger_is_read_once(spark):
    files = QUERIES["j17_reconcile_periods"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any(t in f for f in files for t in ("lineitem", "orders"))
