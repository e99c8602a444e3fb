"""Resets from tails (T10) against a walk through the whole history, under late rows, edits, removals and a clock that moves both ways."""

import random
import time

import pytest
from ledgerloom.operators import windows as W
from ledgerloom.sources import adapters as D
from ledgerloom.streaming import resets as R
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MINUTE, HOUR = 60_000_000, 3_600_000_000
TOLERANCE = W.RESET_TOLERANCE_US


def tails():
    segments, links = {}, {}
    return R.Tails(segments.get, segments.__setitem__, links.__getitem__, lambda n, a, b: links.__setitem__(n, (a, b)), TOLERANCE)


def meter(rng, n, step=30 * MINUTE):
    """Readings of a meter with resets, moved windows, jitter and gaps."""
    out, used, resets = [], 0.0, 7 * 24 * HOUR
    for i in range(n):
        us = i * step
        if us >= resets or rng.random() < 0.01:
            used, resets = 0.0, us + 7 * 24 * HOUR
        used = min(100.0, used + rng.choice([0, 0, 1, 3]))
        if rng.random() < 0.01:
            used = max(0.0, used - rng.choice([3, 8, 60]))
        out.append([us, i, None if rng.random() < 0.03 else used, None if rng.random() < 0.03 else resets + rng.choice([0, 0, 500_000, -900_000])])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_changes_and_clocks(seed):
    rng = random.Random(seed)
    readings, t, head, held, sums = meter(rng, 900), tails(), (None, None), {}, {}
    rng.shuffle(readings)
    while readings or rng.random() < 0.5:
        batch = [[*readings.pop(), False] for _ in range(min(len(readings), rng.randrange(1, 120)))]
        for _ in range(rng.randrange(4)):  # edits, and readings that are taken back
            if held:
                us, ident = rng.choice(list(held))
                batch.append([us, ident, float(rng.randrange(100)), rng.randrange(30) * 24 * HOUR, rng.random() < 0.5])
        clock = rng.choice([10**18, rng.randrange(900) * 30 * MINUTE])
        for us, ident, used, resets, removed in batch:
            held.pop((us, ident), None)
            if not removed:
                held[us, ident] = [us, ident, used, resets]
        head, changes = t.update(head, batch, clock)
        for op, r in changes:
            sums[tuple(r)] = sums.get(tuple(r), 0) + op
        _, want = R.walk(R.START, [held[k] for k in sorted(held) if k[0] <= clock], TOLERANCE)
        assert {k: v for k, v in sums.items() if v} == {tuple(r): 1 for r in want}
        later = [k[0] for k in held if k[0] > clock]
        assert t.pending(head[0], clock) == (min(later) if later else None)


def test_a_batch_costs_what_it_touches():
    """Readings at the end, or months late, walk through a segment or two, however long the history is."""
    rng = random.Random(1)
    cost = {}
    for n in (2_000, 40_000):
        t = tails()
        head, _ = t.update((None, None), [[*r, False] for r in meter(rng, n)], 10**18)
        t.walked = 0
        head, _ = t.update(head, [[n * 30 * MINUTE + i, 10**6 + i, 5.0, 10**15, False] for i in range(5)], 10**18)
        end, t.walked = t.walked, 0
        t.update(head, [[n // 2 * 30 * MINUTE + 1, 10**7, 50.0, 7 * 24 * HOUR * (n // 2), False]], 10**18)
        cost[n] = (end, t.walked)
    assert all(c[0] <= 60 and c[1] <= 1_000 for c in cost.values()), cost


def test_rows_equal_those_of_detect_resets(spark, tmp_path):
    """As a stream over three runs, with late readings and corrections, ids and all columns."""
    q = D.quota_snapshots(spark, SF).withColumn("arrival", F.lit(0)).withColumn("gone", F.lit(False))
    wrong = q.where("observation_id % 11 = 0").withColumn("used", F.lit(99.0))  # put right later
    extra = q.where("observation_id % 13 = 0").withColumn("observation_id", F.col("observation_id") + 10**9).withColumn("used", F.lit(1.0))  # taken back later
    batches = [q.where("observation_id % 3 = 1 and observation_id % 11 != 0").unionByName(wrong).unionByName(extra), q.where("observation_id % 3 = 2 and observation_id % 11 != 0"), q.where("observation_id % 3 = 0 or observation_id % 11 = 0").unionByName(extra.withColumn("gone", F.lit(True)))]
    source, state, out = (str(tmp_path / n) for n in ("source", "state", "out"))
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        s = R.stream_resets(spark.readStream.schema(q.schema).parquet(source), removed="gone", arrival="arrival")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = R.standing(spark.read.schema(s.schema).parquet(out))
    want = W.detect_resets(q)
    rows = lambda df: sorted(map(repr, df.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want) and want.count() > 3


def test_a_clock_column_holds_later_readings_back(spark, tmp_path):
    q = D.quota_snapshots(spark, SF)
    middle = q.agg(F.expr("cast(percentile(us, 0.5) as bigint)")).first()[0]
    source, state, out = (str(tmp_path / n) for n in ("source", "state", "out"))
    one = q.groupBy("account").agg(F.min_by(F.struct(*q.columns), "observation_id").alias("r")).select("r.*")  # a reading each, to bring the clock
    for rows, clock in ((q, middle), (one, 10**18), (one, middle)):
        rows.withColumn("now", F.lit(clock)).coalesce(1).write.mode("append").parquet(source)
        s = R.stream_resets(spark.readStream.schema(q.withColumn("now", F.lit(clock)).schema).parquet(source), clock="now")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        got = sorted(r.event_id for r in R.standing(spark.read.schema(s.schema).parquet(out)).collect())
        assert got == sorted(r.event_id for r in W.detect_resets(q.where(F.col("us") <= clock)).collect())


def test_a_timer_brings_a_later_reading(spark, tmp_path):
    """A meter without further batches: its later reading counts when its time comes."""
    now = int(time.time() * 1e6)
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    one = D.quota_snapshots(spark, SF).limit(1).withColumns({"observation_id": F.lit(1).cast("long"), "us": F.lit(now), "used": F.lit(90.0), "resets_us": F.lit(now + HOUR * 24)})
    two = one.withColumns({"observation_id": F.lit(2).cast("long"), "us": F.lit(now + 20_000_000), "used": F.lit(5.0), "resets_us": F.lit(now + HOUR * 24)})
    one.unionByName(two).coalesce(1).write.parquet(source)
    s = R.stream_resets(spark.readStream.schema(one.schema).parquet(source), timers=True)
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        end, found = time.time() + 90, []
        while not found and time.time() < end:
            time.sleep(2)
            try:
                found = spark.read.schema(s.schema).parquet(out).collect()
            except AnalysisException:  # no file yet
                continue
    finally:
        q.stop()
    assert [(r.op, r.us, r.classification) for r in found] == [(1, now + 20_000_000, "FullReset")]
    assert time.time() * 1e6 > now + 20_000_000
