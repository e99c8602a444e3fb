"""Walks over ranges of long keys (W1, W5, W7) against walks by key."""

import random

import pytest
from ledgerloom.operators import sequence as Q
from ledgerloom.operators import windows as W
from ledgerloom.sources import adapters as D
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def many_ranges(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def test_counters_of_one_session(spark, many_ranges):
    o = D.token_observations(spark, SF)
    one = o.withColumn("session_id", F.when(F.col("session_id") % 9 == 0, F.col("session_id")).otherwise(1))
    assert rows(Q.reduce_counters(one, long_sessions=True)) == rows(Q.reduce_counters(one))
    assert rows(Q.reduce_counters(o, long_sessions=True)) == rows(Q.reduce_counters(o))


def test_epochs_and_resets_of_one_account(spark, many_ranges):
    q = D.quota_snapshots(spark, SF)
    one = q.withColumn("account", F.lit("all"))
    for x in (q, one, one.where("false")):
        assert rows(Q.split_epochs(x, ["account"], long_streams=True)) == rows(Q.split_epochs(x, ["account"]))
        assert rows(W.detect_resets(x, long_streams=True)) == rows(W.detect_resets(x))
    found = Q.split_epochs(one, ["account"], long_streams=True).select(F.spark_partition_id().alias("p")).distinct().count()
    assert found >= 8  # one account, many tasks


@pytest.mark.parametrize("keys", [1, 3, 60])
def test_walks_that_forget_late_or_never(spark, many_ranges, keys):
    def longest(state, row):  # never forgets
        best = max(state, row[0], key=lambda w: (len(w), w))
        return best, (best,)

    def numbered(state, row):
        n = state[0] + (row[0] != state[1])
        return (n, row[0]), (n,)

    rng = random.Random(keys)
    data = [(rng.randrange(keys), i, "x" * rng.choice([1, 1, 2, rng.randrange(1, 40)])) for i in range(3_000)]
    df = spark.createDataFrame(data, "k int, i int, w string").repartition(6)
    assert rows(Q.fold_ranges(df, ["k"], ["i"], ["w"], str, longest, "best string")) == rows(Q.fold(df, ["k"], ["i"], ["w"], str, longest, "best string"))
    start = lambda: (0, None)
    count = lambda s, by: s[0] if by is None else (s[0] + by, s[1])
    assert rows(Q.fold_ranges(df, ["k"], ["i"], ["w"], start, numbered, "n int", count)) == rows(Q.fold(df, ["k"], ["i"], ["w"], start, numbered, "n int"))
