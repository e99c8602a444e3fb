"""Quantiles of all that came before (M22's bands) against sorted lists."""

import math
import random

from ledgerloom.operators.earlier import bands_before, earlier_order_statistics
from ledgerloom.operators.forecasting import Options
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def place(n):
    return max(1, min(n, math.ceil((n + 1) * 0.8)))


def test_order_statistics_of_every_prefix(spark):
    rng = random.Random(11)
    rows = [(key, o, rng.choice([None, 0.0, 1.0, rng.random(), rng.random() * 9])) for key, n in (("a", 300), ("b", 1), ("c", 2), (None, 40)) for o in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "k string, o long, v double").withColumn("key", F.coalesce("k", F.lit("-")))
    at = lambda n: F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * 0.8).cast("int")))
    got = {(r.key, r.o): (r.before, r.low, r.high) for r in earlier_order_statistics(df, ["key"], "o", "v", at).collect()}
    want = {}
    for key, o, v in rows:
        if v is not None:
            past = sorted(x for k, p, x in rows if k == key and p < o and x is not None)
            k = place(len(past) + 1)
            want[key or "-", o] = (len(past), past[k - 2] if 2 <= k <= len(past) + 1 else None, past[k - 1] if k <= len(past) else None)
    assert got == want
    assert earlier_order_statistics(df.limit(0), ["key"], "o", "v", at).count() == 0


def test_bands_of_more_than_forty_blocks(spark):
    rng = random.Random(12)
    rows, at = [], 0
    for i in range(400):
        at += rng.randrange(2 * HOUR, 9 * HOUR)
        rows.append(("ab"[i % 5 == 0], at, at + rng.randrange(1, 2 * HOUR), None, rng.random() * 10 if i > 60 else 30.0 + rng.random()))
    df = spark.createDataFrame(rows, "k string, start_us long, end_us long, resets_us long, loss double")
    from ledgerloom.operators.sequence import chronological_blocks

    block = {(r.k, r.start_us): r.block_id for r in chronological_blocks(df, ["k"], "start_us", "end_us", "resets_us", Options().block_hours).collect()}
    seen = 0
    for r in bands_before(df, ["k"], "loss").collect():
        most = {}
        for k, a, b, _, x in rows:
            if k == r.k and b < r.start_us and block[k, a] is not None:
                most[block[k, a]] = max(most.get(block[k, a], 0), x)
        seen = max(seen, len(most))
        want = sorted(most.values())[place(len(most)) - 1] if len(most) >= Options().least_groups else None
        assert (r.blocks_before, r.radius) == (len(most), want)
    assert seen > 100
