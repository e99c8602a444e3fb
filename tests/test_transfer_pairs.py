"""Scales of many pairs at once are those that each pair has by itself."""

import numpy as np
import pytest
from ledgerloom.operators import studies as S


def test_scales_of_pairs_are_those_of_single_pairs(spark):
    rng = np.random.default_rng(3)
    pairs, rows = [], []
    for k in range(60):
        x, w = rng.integers(0, 20, (2, 5)).astype(float), rng.random(2) * (k % 9 > 0)  # some fits are zero
        lo = (w @ x) * rng.random() * 3 + rng.normal(size=5)
        pairs.append((k, w.tolist(), x[0].tolist(), x[1].tolist(), lo.tolist(), (lo + 1).tolist()))
        rows += [(k, float(v), float(a), float(a + 1)) for v, a in zip(w @ x, lo)]
    got = S._pair_scales(spark.createDataFrame(pairs, "k int, donor_weights array<double>, _x0 array<double>, _x1 array<double>, _lo array<double>, _up array<double>").repartition(4), ["a", "b"], 5).collect()
    want = {r.k: r.scale for r in S._scales(spark.createDataFrame(rows, "k int, v double, lower double, upper double"), ["k"], "v").collect()}
    assert {r.k: r.scale for r in got} == {k: None if v is None else pytest.approx(v, abs=1e-8) for k, v in want.items()} and any(v is None for v in want.values())
