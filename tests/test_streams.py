"""The streaming forms as streams, in several batches and over a restart, against their batch forms."""

import itertools

import pytest
from ledgerloom.operators import windows as W
from ledgerloom.plans import queries_meter as QM
from ledgerloom.sources import adapters as D
from ledgerloom.streaming import streams as T
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


def streamed(spark, tmp_path, rows, order, make, batches=3, mode="append"):
    """What make(stream) gives for rows that come in several batches; the query is stopped and started again for each."""
    source, sink, state = (str(tmp_path / n) for n in ("source", "sink", "state"))
    n = rows.count()
    numbered = rows.withColumn("_b", F.ntile(batches).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(order))).persist()
    assert n
    for b in range(1, batches + 1):
        numbered.where(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").parquet(source)
        out = make(spark.readStream.schema(rows.schema).parquet(source))
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def same(a, b):
    cols = sorted(b.columns)
    plain = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert plain(a) == plain(b)


def test_late_rows(spark, tmp_path):
    e = D.events(spark, SF).select("user_id", "event_id", F.col("event_id").alias("arrival"), (F.col("us") - F.when(F.col("k") % 9 == 0, 48 * HOUR).otherwise(0)).alias("us"))
    same(streamed(spark, tmp_path, e, "arrival", lambda s: T.stream_late(s, HOUR)), T.split_late(e, HOUR, ["user_id"]).select("user_id", "event_id", "us", "late"))


@pytest.mark.parametrize("blind", [False, True])
def test_quota_alerts(spark, tmp_path, blind):
    q = D.quota_snapshots(spark, SF).select("account", "us", "observation_id", "used", F.when(F.lit(not blind) | (F.col("account") != "view"), F.col("resets_us")).alias("resets_us"))
    want = T.quota_alerts(q, ["account"], [10, 25, 50])
    same(streamed(spark, tmp_path, q, "us", lambda s: T.stream_quota_alerts(s, [10, 25, 50])), want)
    assert want.where("alert = 'refreshed'").count() and (not blind or want.where("window like 'generation-%'").count())


def test_health_alerts(spark, tmp_path):
    s = D.events(spark, SF).select("user_id", "event_id", F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("state"))
    same(streamed(spark, tmp_path, s, "event_id", T.stream_health_alerts), T.health_alerts(s, "user_id", "event_id"))


@pytest.mark.parametrize("name", ["usage", "recent", "sessions"])
def test_windows(spark, tmp_path, name):
    """Windows that the watermark has closed are given once, as in the batch."""
    t = D.token_events(spark, SF).select("session_id", "total", F.timestamp_micros("us").alias("time"))
    make = {"usage": lambda s: T.stream_usage(s, "time", "1 hour", "1 hour"), "recent": lambda s: T.stream_recent(s, "time", "1 hour", "30 minutes", "1 hour"), "sessions": lambda s: T.stream_idle_sessions(s, "time", "1 hour")}[name]
    got, want = streamed(spark, tmp_path, t, "time", make), make(t)
    plain = lambda df: set(map(repr, df.collect()))
    assert plain(got) <= plain(want) and got.count() == len(plain(got)) > 0.8 * want.count()


def test_resets_of_late_readings(spark, tmp_path):
    """Batches that overlap in time end with the resets of all readings."""
    q = D.quota_snapshots(spark, SF).withColumn("batch", F.col("observation_id") % 3).persist()
    found = {}
    for b in range(3):
        history, new = q.where(F.col("batch") < b), q.where(F.col("batch") == b)
        first = {r.account: r.m for r in new.groupBy("account").agg(F.min("us").alias("m")).collect()}
        got = T.refresh_resets(history.drop("batch"), new.drop("batch"), ["account"]).collect()
        found = {k: v for k, v in found.items() if k[0] not in first or k[1] < first[k[0]]} | {(r.account, r.us, r.classification): r for r in got}
    want = {(r.account, r.us, r.classification) for r in W.detect_resets(q.drop("batch")).collect()}
    assert set(found) == want


def test_resets_through_for_each_batch(spark, tmp_path):
    q = D.quota_snapshots(spark, SF)
    source, log, state = (str(tmp_path / n) for n in ("source", "log", "state"))
    q.limit(0).write.parquet(log)
    found = []

    def sink(df, epoch):
        found.extend((r.account, r.us, r.classification) for r in df.collect())

    for low, high in itertools.pairwise((0, QM.DAY0 + 300 * HOUR, QM.DAY0 + 500 * HOUR, 2**62)):
        part = q.where((F.col("us") >= low) & (F.col("us") < high))
        part.coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(q.schema).parquet(source)
        s.writeStream.foreachBatch(T.keep_resets(lambda: spark.read.schema(q.schema).parquet(log), ["account"], sink)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        part.write.mode("append").parquet(log)
    assert sorted(found) == sorted((r.account, r.us, r.classification) for r in W.detect_resets(q).collect())
