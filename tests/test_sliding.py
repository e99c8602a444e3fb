"""Sums, distinct keys and last values of the time before origins against plain Python, and that rows do not grow with pairs."""

import random

from ledgerloom.operators.sliding import active_at, latest_before, merged, pieces_of
from pyspark.sql import functions as F

WIDTH = 10


def test_time_before_origins_as_plain_python_has_it(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(120), rng.choice("ab"), rng.choice([None, *range(6)]), rng.randrange(-3, 9), rng.choice([None, *range(130)])) for i in range(400)]
    e = spark.createDataFrame(rows, "id long, us long, kind string, session int, v long, seen long")
    at = list(range(0, 140, 3)) + [30, 30]
    origins = spark.createDataFrame([(o,) for o in at], "origin_us long")
    for known in (None, "seen"):
        p = pieces_of(e, WIDTH, known=None if known is None else F.col(known))
        inside = lambda r, o: o - WIDTH < r[1] <= o and (known is None or (r[5] is not None and r[5] <= o))  # noqa: E731, B023
        got = {(r.origin_us, r.kind): r.v for r in active_at(p.withColumn("n", F.lit(1)), origins, WIDTH, ["kind"], ["v", "n"]).where("n > 0").collect()}
        assert got == {(o, k): sum(r[4] for r in rows if r[2] == k and inside(r, o)) for o in at for k in "ab" if any(r[2] == k and inside(r, o) for r in rows)}
        s = merged(p.where("session is not null"), ["session"]).withColumn("n", F.lit(1))
        assert {r.origin_us: r.n for r in active_at(s, origins, WIDTH, [], ["n"]).collect()} == {o: len({r[3] for r in rows if r[3] is not None and inside(r, o)}) for o in at}
    want = {o: max(((r[1], r[0], r[4]) for r in rows if o - WIDTH < r[1] <= o), default=(0, 0, None))[2] for o in at}
    assert {r.origin_us: r.value for r in latest_before(e, origins, WIDTH, F.col("v"), ["us", "id"]).collect()} == {o: v for o, v in want.items() if v is not None}


def test_dense_events_and_origins_make_no_pairs(spark):
    n = 300_000  # of which each origin would meet all before it: 45 thousand million pairs
    e = spark.range(n).select(F.col("id").alias("us"), F.lit(1).cast("long").alias("v"))
    got = active_at(pieces_of(e, n), e.select(F.col("us").alias("origin_us")), n, [], ["v"])
    assert got.agg(F.count("v"), F.sum("v")).first() == (n, n * (n + 1) // 2)
