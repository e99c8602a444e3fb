"""Step functions and the operators that run them, on small hand-made series."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.operators import sequence as Q
from ledgerloom.operators import windows as W
from pyspark.sql import functions as F

S, H = 1_000_000, 3_600_000_000


def c(total, inp=None, cached=0, write=0, out=None, reason=0):
    return (total if inp is None else inp, cached, write, (0 if out is None else out), reason, total)


def run(rows):
    state, out = None, []
    for r in rows:
        state, v = Q.reduce_step(state, r)
        out.append((v[0], v[-1]))
    return out


def test_cumulative_totals_with_a_reset():
    assert run([(1, 1, c(1100), None), (2, 2, c(1100), None), (3, 3, c(1650), None), (4, 4, c(220), None)]) == [("FirstObservation", 1100), ("NoIncrement", 0), ("MonotonicIncrement", 550), ("CounterReset", 0)]


def test_duplicate_stale_and_empty_observations():
    assert run([(1, 5, c(100), None), (1, 5, c(100), None), (2, 4, c(200), None), (3, 6, None, None)]) == [("FirstObservation", 100), ("Duplicate", 0), ("StaleObservation", 0), ("NoObservation", 0)]


def test_a_covered_regression_is_stale_and_keeps_the_watermark():
    assert run([(1, 1, c(1000), None), (2, 2, c(990), c(5)), (3, 3, c(1010), None)]) == [("FirstObservation", 1000), ("StaleCumulativeRegression", 0), ("MonotonicIncrement", 10)]


def test_last_only_rows_make_a_synthetic_watermark():
    assert run([(1, 1, None, c(50)), (2, 2, None, c(30)), (3, 3, c(100), None), (4, 4, c(150), None)]) == [("FirstObservation", 50), ("MonotonicIncrement", 30), ("MonotonicIncrement", 20), ("MonotonicIncrement", 50)]


def test_incomplete_counters_count_as_missing():
    assert run([(1, 1, (1, None, 0, 0, 0, 10), c(7))]) == [("FirstObservation", 7)]


def test_saturation_does_not_wrap():
    top = 2**63 - 1
    assert run([(1, 1, None, c(top)), (2, 2, None, c(top))])[1] == ("MonotonicIncrement", top)


def test_categories_are_clamped_in_stages():
    assert Q.disjoint((10, 8, 5, 3, 7, 13)) == (0, 8, 5, 0, 7, 13)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30))
def test_monotone_totals_add_up(steps):
    total, rows = 0, []
    for i, s in enumerate(steps):
        total += s
        rows.append((i, i, c(total), None))
    assert sum(v for _, v in run(rows)) == total


def _epochs(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k int, observation_id int, us long, used double, resets_us long")
    return [r.epoch_id for r in Q.split_epochs(df, ["k"]).orderBy("observation_id").collect()]


def test_epochs_cut_at_nulls_drops_and_resets(spark):
    end = 100 * S
    assert _epochs(spark, [(1, 1.0, end), (2, None, end), (3, 2.0, end), (4, 1.0, end), (5, 1.0, end + 5 * S), (101 * S, 1.0, end)]) == [1, None, 2, 3, 4, None]


def test_reset_jitter_is_not_chained(spark):
    end = 10_000 * S
    assert _epochs(spark, [(1, 1.0, end), (2, 1.0, end + S), (3, 1.0, end + 2 * S)]) == [1, 1, 2]


def test_ties_repeat_or_conflict(spark):
    end = 100 * S
    assert _epochs(spark, [(1, 1.0, end), (1, 1.0, end), (1, 3.0, end)]) == [1, None, 2]


def test_blocks_do_not_overlap_or_cross_resets(spark):
    rows = [(1, 0, 2 * H, 99 * H), (1, 1 * H, 3 * H, 99 * H), (1, 2 * H, 3 * H, 99 * H), (1, 7 * H, 8 * H, 99 * H), (1, 8 * H, 100 * H, 99 * H)]
    df = spark.createDataFrame(rows, "k int, start_us long, end_us long, resets_us long")
    got = [r.block_id for r in Q.chronological_blocks(df, ["k"]).orderBy("start_us", "end_us").collect()]
    assert got == [1, None, 1, 2, None]


def test_fold_does_not_depend_on_partitions_or_order(spark):
    rng = random.Random(3)
    rows = [(s, i, i * S, rng.randrange(1000)) for s in range(5) for i in range(40)]
    def total(n, seed):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "session_id int, source_event_id int, us long, t int").repartition(n)
        t = F.struct(*(F.col("t").cast("long").alias(x) for x in Q.COUNTERS))
        r = Q.reduce_counters(df.select("session_id", "source_event_id", "us", t.alias("total"), F.lit(None).cast("struct<input:long,cached:long,cache_write:long,output:long,reasoning:long,total:long>").alias("last")))
        return sorted(tuple(x) for x in r.select("session_id", "source_event_id", "kind", "epoch", "delta_total").collect())

    assert total(1, 1) == total(7, 2)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, start_us long, end_us long, resets_us long")
    assert Q.chronological_blocks(df, ["k"]).count() == 0


def test_time_ewma_ignores_how_often_flat_readings_are_polled(spark):
    def last(step):
        rows = [(1, m * 60 * S, float(m // 60)) for m in range(0, 241, step)]
        e = W.pace_estimates(spark.createDataFrame(rows, "k int, us long, used double"), ["k"])
        return e.orderBy(F.desc("us")).first()

    assert last(5).epoch == pytest.approx(last(20).epoch) == pytest.approx(1.0)
    assert last(5).time_ewma_2h == pytest.approx(last(20).time_ewma_2h, rel=0.15)


def _resets(spark, pairs):
    base = "provider string, profile string, kind string, source string, account string, limit_id string, plan string, session string, window_minutes int, observation_id long, us long, used double, resets_us long"
    rows = [("codex", "d", "Weekly", "x-app-server:y", "a", None, None, None, 10080, i, *p) for i, p in enumerate(pairs)]
    return [r.classification for r in W.detect_resets(spark.createDataFrame(rows, base)).orderBy("us").collect()]


def test_reset_classes(spark):
    end = 1000 * S
    assert _resets(spark, [(1, 50.0, end), (2, 50.0, end + S)]) == []
    assert _resets(spark, [(end - S, 50.0, end), (end + S, 1.0, 2 * end)]) == ["ExpectedReset"]
    assert _resets(spark, [(1, 90.0, 10**6 * S), (2, 1.0, 2 * 10**6 * S)]) == ["FullReset"]
    assert _resets(spark, [(1, 10.0, 10**6 * S), (2, 10.0, 2 * 10**6 * S)]) == ["ReanchoredWindow"]
    assert _resets(spark, [(1, 10.0, end), (2, 3.0, end)]) == ["UnusualReset"]


def test_history_reasons(spark):
    from ledgerloom.operators.windows import describe_history

    schema = "provider string, profile string, kind string, source string, account string, limit_id string, plan string, session string, window_minutes int, observation_id long, us long, used double, resets_us long"
    row = lambda i, us, used, src="x-app-server:y", sess=None, kind="Weekly": ("codex", "d", kind, src, None, None, None, sess, 10080, i, us, used, 100 * S)
    rows = [row(1, 1, 5.0), row(2, 1, 6.0), row(3, 2, 7.0), row(4, 2, 7.0), row(5, 3, None), row(6, 9 * S, 8.0), row(7, 4, 1.0, "elsewhere"), row(8, 4, 1.0, kind="Unknown"),
            row(9, 1, 5.0, "rollout", "s"), row(10, 2, 5.0, "rollout", "s"), row(11, 3, 6.0, "rollout", None)]
    got = {r.observation_id: r.reason for r in describe_history(spark.createDataFrame(rows, schema), 5 * S).collect()}
    assert got == {1: "same-time-conflict", 2: "same-time-conflict", 3: "historical-app-server", 4: "same-time-repeat", 5: "invalid-window", 6: "future-event", 7: "unsupported-source", 8: "unsupported-window",
                   9: "historical-embedded-account-unverified", 10: "possibly-cached-repeat", 11: "legacy-missing-provenance"}


def test_stream_reducer_equals_batch(spark):
    from ledgerloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    cols = ["session_id", "source_event_id", "kind", "epoch", "uncached", "delta_total"]
    a = sorted(tuple(r) for r in QUERIES["t2_stream_counters"](spark, sf).select(cols).collect())
    b = sorted(tuple(r) for r in QUERIES["w1_reduce_counters"](spark, sf).select(cols).collect())
    assert a == b


def test_ridge_matches_numpy(spark):
    import numpy as np
    from ledgerloom.operators.forecasting import ridge_fit

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 10, 100]
    y = x @ [2, -1, 0.5] + 3 + rng.normal(size=200)
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y)], "g int, a double, b double, c double, y double")
    r = ridge_fit(df, ["a", "b", "c"], "y", 1.0, ["g"]).first()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(r.weights, w) and np.isclose(r.intercept, y.mean() - w @ x.mean(0))


def test_ridge_before_equals_refit(spark):
    import numpy as np
    from ledgerloom.operators.forecasting import ridge_before, solve_ridge

    rng = np.random.default_rng(2)
    rows = [("a", 10 * i, 10 * i + 15, float(rng.normal()), float(rng.normal())) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, origin_us long, outcome_us long, x double, y double")
    got = {r.origin_us: r for r in ridge_before(df, ["k"], ["x"], "y", 1.0, 20, 12).collect()}
    for _, o, _, _, _ in rows:
        past = [r for r in rows if r[2] <= o][-20:]
        if len(past) < 12:
            assert got[o].weights is None
            continue
        x, y = np.array([r[3] for r in past]), np.array([r[4] for r in past])
        b, w = solve_ridge({"n": len(past), "y": y.sum(), "s0": x.sum(), "t0": (x * y).sum(), "p0_0": (x * x).sum()}, 1, 1.0)
        assert np.isclose(got[o].intercept, b) and np.isclose(got[o].weights[0], w[0])


def test_nonnegative_ridge_recovers_weights():
    import numpy as np
    from ledgerloom.operators.forecasting import nonnegative_ridge

    rng = np.random.default_rng(3)
    x = rng.random((60, 2)) * [100, 10]
    y = x @ [0.02, 0.3]
    w = nonnegative_ridge(x, y - 0.01, y + 0.01, 1e-6, steps=20_000)
    assert np.abs(x @ w - y).max() < 0.2 and (w >= 0).all()
