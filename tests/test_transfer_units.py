"""Transfers between cohorts, made in units of a few donors and cohorts, against plain Python."""

import numpy as np
import pytest
from ledgerloom.functions.scalars import CATEGORIES
from ledgerloom.operators import studies as S
from ledgerloom.operators.forecasting import nonnegative_ridge, nonnegative_ridges

MINUTE, HOUR = 60_000_000, 3_600_000_000
WORK = ["uncached", "output"]


def observations(spark, rng):
    """Cohorts of two groups, one after the other or overlapping; some have few rows, some no movement, some many held-out rows."""
    rows = []
    for group, cohorts in (("a", 23), ("b", 9)):
        at = 0
        for c in range(cohorts):
            w, us = rng.random(2) * (c % 4 > 0), at
            for _ in range(int(rng.choice([3, 6, 12, 30]))):
                work = {n: float(rng.integers(0, 20)) for n in CATEGORIES}
                low = max(0.0, float(w @ [work[n] for n in WORK]) * (1 + c % 3) + rng.normal())
                rows.append({"account": group, "epoch_id": c, "start_us": us, "end_us": us + 50 * MINUTE, "resets_us": 10**15, "lower": low, "upper": low + 1, **work})
                us += int(rng.choice([1, 5])) * HOUR
            at = us if c % 5 else at + HOUR
    return spark.createDataFrame(rows).cache()


def plain(rows, first):
    """(account, cohort, donor) -> rows, blocks, reused, rescaled, local, nothing."""
    cohorts, out = {}, {}
    for r in sorted((r.asDict() for r in rows), key=lambda r: r["start_us"]):
        cohorts.setdefault((r["account"], r["epoch_id"]), []).append(r)
    cohorts = {k: v for k, v in cohorts.items() if len(v) >= first}
    x = lambda rows: np.array([[r[c] for c in WORK] for r in rows])
    bound = lambda rows, c: np.array([r[c] for r in rows])
    fits = {k: nonnegative_ridge(x(v[:first]), bound(v[:first], "lower"), bound(v[:first], "upper")) for k, v in cohorts.items()}
    for k, v in cohorts.items():
        train, blocks, began = v[:first], [], None
        for r in v[first:]:
            if began is None or r["start_us"] - began >= 6 * HOUR:
                blocks.append([])
                began = r["start_us"]
            blocks[-1].append(r)
        if not blocks:
            continue
        loss = lambda value: float(np.mean([np.mean([max(0.0, r["lower"] - value(r), value(r) - r["upper"]) for r in b]) for b in blocks]))  # noqa: E731, B023
        for d, w in fits.items():
            if d == k or d[0] != k[0] or max(r["end_us"] for r in cohorts[d]) > min(r["start_us"] for r in v):
                continue
            given, lo, up, scale = x(train) @ w, bound(train, "lower"), bound(train, "upper"), 0.0
            for _ in range(200 if (given**2).mean() > 1e-12 else 0):
                new = max(0.0, scale - (given * (given * scale - np.clip(given * scale, lo, up))).mean() / (given**2).mean())
                if abs(new - scale) < 1e-10:
                    break
                scale = new
            of = lambda w, s: loss(lambda r: float(w @ [r[c] for c in WORK]) * s)  # noqa: E731, B023
            out[k[0], k[1], d[1]] = (len(v) - first, len(blocks), of(w, 1), of(w, scale), of(fits[k], 1), of(w, 0))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = observations(spark, np.random.default_rng(11))
    return rows, plain(rows.collect(), 5)


@pytest.mark.parametrize("sizes", [{}, {"DONORS": 4, "COHORTS": 3, "PIECE": 2, "TRANSFERS": 7, "TRANSFERS_PER_TASK": 20}])
def test_pairs_of_all_units_are_those_of_single_pairs(made, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(S, name, n)
    got = S.transfer_evaluation(made[0], ["account"], "epoch_id", WORK, 5).collect()
    found = {(r.account, r.epoch_id, r.donor): r for r in got}
    assert len(found) == len(got) and set(found) == set(made[1]) and len(got) > 100
    for k, (rows, blocks, reused, rescaled, local, nothing) in made[1].items():
        r = found[k]
        assert (r.rows, r.blocks) == (rows, blocks) and [r.reused, r.local, r.nothing] == pytest.approx([reused, local, nothing], abs=1e-8)
        assert r.rescaled == pytest.approx(rescaled, abs=1e-6)
    assert any(nothing > 0 for k, (*_, nothing) in made[1].items() if k[2] % 4 == 0)  # donors whose fit is zero


def test_no_pairs_are_shuffled(made):
    plan = S.transfer_evaluation(made[0], ["account"], "epoch_id", WORK, 5)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in above for x in ("Join", "Aggregate", "Repartition", "Sort"))


def test_no_pairs(spark, made):
    assert S.transfer_evaluation(made[0].limit(0), ["account"], "epoch_id", WORK, 5).collect() == []
    assert S.transfer_evaluation(made[0].where("epoch_id = 5"), ["account"], "epoch_id", WORK, 5).collect() == []


def test_ridges_of_many_cohorts_are_those_of_single_ones():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (40, 8, 2)).astype(float) * (np.arange(40) % 7 > 0)[:, None, None]
    low = (x @ rng.random((40, 2, 1)))[:, :, 0] + rng.normal(size=(40, 8))
    many = nonnegative_ridges(x, low, low + 1)
    assert np.allclose(many, [nonnegative_ridge(*one) for one in zip(x, low, low + 1)], atol=1e-9) and (many[7] == 0).all() and (many > 0).any()


def test_cost_intervals_are_made_once(spark):
    from ledgerloom.plans.queries_meter import _cost

    plan = _cost(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cost-intervals" in "".join(_cost(spark, "/root/testdata/sf0.001").inputFiles()) and "MapInArrow" not in plan
