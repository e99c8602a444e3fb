"""Trials, bands, fits and studies against plain Python on the smallest tables."""

import collections
import itertools
import math

import numpy as np
import pytest
from ledgerloom.functions.scalars import CATEGORIES
from ledgerloom.operators import forecasting as M
from ledgerloom.operators import studies as S
from ledgerloom.operators import windows as W
from ledgerloom.plans import queries_meter as QM
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sources import adapters as D
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000
near = lambda x: pytest.approx(x, rel=1e-6, abs=1e-6, nan_ok=True)


def records(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(rows, *keys):
    out = collections.defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def blocks(rows, start, end, hours=6.0):
    """Chronological blocks of rows that do not overlap; a new one begins after `hours` or with another reset."""
    out, last, began, reset = [], None, None, None
    for r in sorted(rows, key=lambda r: (r[start], r[end])):
        if r[end] <= r[start] or r[end] > r["resets_us"] or (last is not None and r[start] < last):
            continue
        if began is None or r[start] - began >= hours * HOUR or abs(r["resets_us"] - reset) > 1_000_000:
            out.append([])
            began, reset = r[start], r["resets_us"]
        out[-1].append(r)
        last = r[end]
    return out


def rank_radius(errors, least=8, coverage=0.8, floor=1.0):
    if len(errors) < least:
        return None
    return max(floor, sorted(errors)[min(len(errors), math.ceil((len(errors) + 1) * coverage)) - 1])


def mean(values):
    values = list(values)
    return sum(values) / len(values) if values else None


def loss(r, predicted):
    return max(0.0, r["lower"] - predicted, predicted - r["upper"])


def ridge(x, y, penalty):
    """Intercept and weights of a standardised ridge, by the normal equations."""
    x, y = np.array(x, dtype=float), np.array(y, dtype=float)
    scale = x.std(0)
    scale[scale < 1e-12] = 1.0
    z = (x - x.mean(0)) / scale
    w = np.linalg.solve(z.T @ z / len(z) + np.eye(x.shape[1]) * penalty / len(z), z.T @ (y - y.mean()) / len(z)) / scale
    return y.mean() - w @ x.mean(0), w


@pytest.fixture(scope="module")
def trials(spark):
    t = QM._trials(spark, SF).persist()
    t.count()
    return t


@pytest.fixture(scope="module")
def cost(spark):
    c = QM._cost(spark, SF).persist()
    c.count()
    return c


def frozen(rows, first=20):
    """(training, held out) of one cohort's rows."""
    rows = sorted(rows, key=lambda r: (r["start_us"], r["end_us"]))
    return rows[:first], [r for r in rows[first:] if r["start_us"] >= max(x["end_us"] for x in rows[:first])]


# --- M3, M4, M26


def test_bands_come_from_earlier_blocks(trials):
    options = M.Options(least_groups=4)
    got = records(M.calibration_errors(trials, ["account", "model"], options))
    assert len(got) == trials.count()
    streams = by(got, "account", "model")
    some = 0
    for r in got:
        past = [x for x in streams[r["account"], r["model"]] if x["outcome_us"] < r["origin_us"]]
        assert all(r["lead_hours"] / 2 <= x["lead_hours"] <= 2 * r["lead_hours"] for x in past)
        want = rank_radius([max(x["error"] for x in b) for b in blocks(past, "origin_us", "outcome_us")][-40:], 4)
        assert r["radius"] == near(want) if want is not None else r["radius"] is None
        some += want is not None
    assert some > 10
    figures = {(r["account"], r["model"]): r for r in records(M.uncertainty_diagnostics(M.calibration_errors(trials, ["account", "model"], options), ["account", "model"]))}
    for k, rows in by([r for r in got if r["radius"] is not None], "account", "model").items():
        assert figures[k]["contained"] == near(mean(r["lower"] <= r["observed"] <= r["upper"] for r in rows)) and figures[k]["width"] == near(mean(r["upper"] - r["lower"] for r in rows))


def test_bands_of_more_blocks_than_are_looked_at(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i * 7 * HOUR, i * 7 * HOUR + 6 * HOUR, 10**18, 6.0, float(e), 50.0, 50.0) for i, e in enumerate(rng.integers(0, 90, 120))]
    t = spark.createDataFrame(rows, "account string, origin_us long, outcome_us long, resets_us long, lead_hours double, error double, predicted double, observed double")
    for r in records(M.calibration_errors(t, ["account"])):
        i = r["origin_us"] // (7 * HOUR)
        want = rank_radius([x[5] for x in rows[max(0, i - 40) : i]])
        assert r["radius"] == want and len(r["calibration"]) == min(i, 40)


def test_reset_targets_have_one_error_for_each_completed_reset(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        reset = (g + 1) * 100 * HOUR
        for lead in rng.choice(np.arange(1, 60), 6, replace=False):
            rows.append(("a", int(reset - lead * HOUR), reset, reset, float(lead), float(rng.integers(0, 50)), 40.0, 50.0))
    t = spark.createDataFrame(rows, "account string, origin_us long, outcome_us long, resets_us long, lead_hours double, error double, predicted double, observed double")
    got = {(r["origin_us"], r["lead_hours"]): r for r in records(M.reset_calibration_errors(t, ["account"]))}
    for r in rows:
        want = []
        for reset in sorted({x[3] for x in rows if x[3] < r[1] - 1_000_000 and x[3] != r[3]}):
            like = [x for x in rows if x[3] == reset and r[4] / 2 <= x[4] <= 2 * r[4]]
            if like:
                want.append(min(like, key=lambda x: (abs(x[4] - r[4]), -x[1]))[5])
        assert sorted(got[r[1], r[4]]["calibration"]) == sorted(want) and got[r[1], r[4]]["radius"] == rank_radius(want)


# --- M7, M37


def test_horizons_choose_model_and_band(spark):
    epochs = QM._epochs(spark, SF)
    got = records(M.horizon_predictions(epochs, ["account"], (2.0,), options=M.Options(bands_from=5)))
    rows = records(M.replay_trials(epochs, ["account"], 2.0))
    now = {r["account"]: r for r in records(W.pace_estimates(epochs.where("epoch_id is not null"), ["account", "epoch_id"]).orderBy("us"))}
    assert got
    for r in got:
        errors = {}
        for m in W.PACE_MODELS:
            free, end = [], None
            for x in sorted((x for x in rows if x["account"] == r["account"] and x["model"] == m), key=lambda x: x["origin_us"]):
                if end is None or x["origin_us"] >= end:
                    free.append(x["error"])
                    end = x["outcome_us"]
            errors[m] = free[-48:]
        usual = "time_ewma_2h"
        best = min(W.PACE_MODELS, key=lambda m: (mean(errors[m]), W.PACE_MODELS.index(m)))
        choice = best if len(errors[usual]) >= 6 and mean(errors[best]) + 0.05 < 0.9 * mean(errors[usual]) else usual
        last = now[r["account"]]
        hours = {"damped_2h": 2 * (1 - math.exp(-1)), "damped_6h": 6 * (1 - math.exp(-1 / 3))}.get(choice, 2.0)
        assert r["selected"] == choice and r["predicted"] == near(min(100, max(0, 100 - last["used"] - last[choice] * hours)))
        assert r["radius"] == rank_radius(errors[choice], 5) or r["radius"] == near(rank_radius(errors[choice], 5))


def test_a_correction_is_taken_when_it_wins(spark):
    """A meter that moves with the tokens, which pace cannot see, but the correction can."""
    rows, used = [], 0.0
    work = [(i * 7919) % 13 for i in range(400)]
    for i in range(400):
        rows.append(("a", 1, i, i * HOUR, used, 10**15))
        used += work[i] / 100
    e = spark.createDataFrame(rows, "account string, epoch_id int, observation_id long, us long, used double, resets_us long")
    # what is about to be done is known at the origin
    f = spark.createDataFrame([(i * HOUR, float(sum(work[i : i + 2]))) for i in range(400)], "origin_us long, tokens double")
    r = records(M.horizon_predictions(e, ["account"], (2.0,), features=f, names=("tokens",)))[0]
    assert r["selected"] in ("workload", "time_ewma_2h") and r["workload_trials"] > 6


def test_current_points_are_those_of_the_open_lanes(spark):
    got = records(QUERIES["m37_current_points"](spark, SF))
    assert got and all((r["withheld"] is None) == (r["state"] is not None and r["horizons"] > 0) or r["withheld"] == "no-epoch" or r["horizons"] == 0 for r in got)


# --- M9, M10, M11, M12, M14, M16


def test_corrections_are_ridges_on_earlier_residuals(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i * HOUR, i * HOUR + 2 * HOUR, float(rng.integers(20, 80)), float(rng.integers(20, 80)), float(rng.integers(0, 9)), ["x"] if i < 60 else ["x", "y"] if i < 66 else ["x"]) for i in range(150)]
    t = spark.createDataFrame(rows, "account string, origin_us long, outcome_us long, predicted double, observed double, tokens double, seen array<string>").withColumn("error", F.abs(F.col("predicted") - F.col("observed")))
    got = {r["origin_us"]: r for r in records(M.workload_correction(t, ["account"], ["tokens"], 10.0, "seen"))}
    for r in rows:
        past = [x for x in rows if x[2] <= r[1]][-120:]
        new = "y" in r[6] and not any("y" in x[6] for x in past)
        want = r[3]
        if len(past) >= 12 and not new:
            a, w = ridge([[x[5]] for x in past], [x[4] - x[3] for x in past], 10.0)
            want = min(100, max(0, r[3] + a + w[0] * r[5]))
        assert got[r[1]]["corrected"] == near(want) and got[r[1]]["unseen"] == (new or not past)
    b = {r["candidate"]: r for r in records(M.backtest_candidates(t, ["account"], {"tokens": ["tokens"]}))}
    plain = {r["origin_us"]: r for r in records(M.workload_correction(t, ["account"], ["tokens"]))}
    assert b["pace"]["mae"] == near(mean(abs(r[3] - r[4]) for r in rows)) and b["tokens"]["mae"] == near(mean(abs(plain[r[1]]["corrected"] - r[4]) for r in rows))


def test_token_forecasts(spark):
    got = records(QUERIES["m11_token_forecast"](spark, SF))
    names = ("recent_30m", "recent_2h", "median_8", "linear_ridge", "log_ridge")
    for rows in by(got, "model").values():
        rows.sort(key=lambda r: r["origin_us"])
        for i, r in enumerate(rows):
            before = [float(x["target"]) for x in rows[max(0, i - 8) : i]]
            assert r["median_8"] == near(float(np.median(before)) if before else r["recent_30m"])
            past = [x for x in rows if x["outcome_us"] <= r["origin_us"]][-120:]
            lin, log = r["recent_30m"], r["recent_30m"]
            if len(past) >= 12:
                a, w = ridge([[x["recent_30m"], x["recent_2h"]] for x in past], [x["target"] for x in past], 1.0)
                lin = max(0, a + w @ [r["recent_30m"], r["recent_2h"]])
                a, w = ridge([[math.log1p(x["recent_30m"]), math.log1p(x["recent_2h"])] for x in past], [math.log1p(x["target"]) for x in past], 1.0)
                log = max(0, math.expm1(min(60, a + w @ [math.log1p(r["recent_30m"]), math.log1p(r["recent_2h"])])))
            assert r["linear_ridge"] == pytest.approx(lin, rel=1e-4, abs=1e-3) and r["log_ridge"] == pytest.approx(log, rel=1e-4, abs=1e-3)
            window = rows[max(0, i - 48) : i]
            errors = {c: mean(abs(x[c] - x["target"]) for x in window) for c in names}
            if len(window) >= 16:
                best = min(names, key=lambda c: (errors[c], names.index(c)))
                assert r["selected"] == (best if errors[best] <= 0.8 * errors["recent_30m"] else "recent_30m")
            else:
                assert r["selected"] == "recent_30m"
            assert r["prediction"] == near(r[r["selected"]])
            misses = sorted(abs(x["prediction"] - x["target"]) for x in window)
            assert r["radius"] == near(misses[math.ceil(len(misses) * 0.8) - 1] if len(misses) >= 20 else None) if len(misses) >= 20 else r["radius"] is None
    scores = {(r["model"], r["candidate"]): r for r in records(QUERIES["m12_token_forecast_scores"](spark, SF))}
    for (m,), rows in by(got, "model").items():
        for c in (*names, "prediction"):
            e = [abs(r[c] - r["target"]) for r in rows]
            assert scores[m, c]["mae"] == near(mean(e)) and scores[m, c]["rmse"] == near(math.sqrt(mean(x * x for x in e)))


def test_activity_hurdles_and_their_study(spark):
    got = records(QUERIES["m14_activity_hurdle"](spark, SF))
    tokens = by(records(D.token_events(spark, SF).where("total > 0").select("model", "us")), "model")
    for (m,), rows in by(got, "model").items():
        rows.sort(key=lambda r: r["origin_us"])
        times = [x["us"] for x in tokens[m,]]
        for i, r in enumerate(rows):
            age = (r["origin_us"] - max(t for t in times if t <= r["origin_us"])) / 60e6
            group = "0-5m" if age < 5 else "5-10m" if age < 10 else "10-30m" if age < 30 else "30-120m" if age < 120 else "older"
            same, last = [x for x in rows[:i] if x["recency"] == r["recency"]], rows[max(0, i - 120) : i]
            used = same if len(same) >= 20 else last
            amounts = sorted(float(x["target"]) for x in last if x["target"] > 0)
            assert r["recency"] == group and r["probability"] == near((sum(x["active"] for x in used) + 1) / (len(used) + 2)) and r["baseline"] == near((sum(x["active"] for x in last) + 1) / (len(last) + 2))
            assert r["conditional_mean"] == near(mean(amounts)) if amounts else r["conditional_mean"] is None
    study = {(r["model"], r["part"], r["candidate"]): r for r in records(QUERIES["m16_usual_activity_study"](spark, SF))}
    for (m,), rows in by(got, "model").items():
        a, z = min(r["origin_us"] for r in rows), max(r["origin_us"] for r in rows)
        for part in ("development", "final"):
            mine = [r for r in rows if (r["origin_us"] < a + (z - a) * 0.8) == (part == "development")]
            e = [r["probability"] * (r["conditional_mean"] or 0) - r["target"] for r in mine]
            assert study[m, part, "hurdle"]["mae"] == near(mean(map(abs, e))) and study[m, part, "hurdle"]["signed"] == near(sum(e)) and study[m, part, "zero"]["mae"] == near(mean(r["target"] for r in mine))


# --- M20 to M24, M43


def test_observations_do_not_overlap_and_add_up(spark, cost):
    rows = records(cost)
    events = records(D.token_events(spark, SF).select("us", *CATEGORIES))
    for lane in by(rows, "account", "epoch_id").values():
        lane.sort(key=lambda r: r["start_us"])
        assert all(a["end_us"] <= b["start_us"] for a, b in itertools.pairwise(lane))
    for r in rows[:60]:
        mine = [e for e in events if r["start_us"] < e["us"] <= r["end_us"]]
        assert r["events"] == len(mine) and all(r[c] == sum(e[c] for e in mine) for c in CATEGORIES) and r["lower"] <= max(0, r["end_used"] - r["start_used"]) <= r["upper"]


def weights_of(df):
    return {tuple(v for k, v in r.items() if k not in ("n", "weights")): np.array(r["weights"]) for r in records(df)}


def test_interval_ridge_has_no_better_neighbour(cost):
    fits = weights_of(M.interval_ridge(cost, ["account"], QM.COST))
    for (account,), rows in by(records(cost), "account").items():
        train, _ = frozen(rows)
        x = np.array([[r[c] for c in QM.COST] for r in train])
        scale = np.sqrt((x * x).mean(0))

        def goal(w):
            y = x @ w
            miss = np.maximum(0, np.array([r["lower"] for r in train]) - y) + np.maximum(0, y - np.array([r["upper"] for r in train]))
            return (miss**2).mean() / 2 + 0.1 * ((w * scale) ** 2).sum() / 2

        w, best = fits[account,], goal(fits[account,])
        assert (w >= 0).all()
        for i, step in itertools.product(range(len(w)), (1e-3, -1e-3)):
            other = w.copy()
            other[i] = max(0, w[i] + step / scale[i])
            assert goal(other) >= best - 1e-7


def test_cost_evaluation(cost):
    got = {(r["account"], r["candidate"]): r for r in records(S.cost_evaluation(cost, ["account"], {"categories": QM.COST}, parent="pace"))}
    fits = weights_of(M.interval_ridge(cost, ["account"], QM.COST))
    for (account,), rows in by(records(cost), "account").items():
        _, late = frozen(rows)
        late.sort(key=lambda r: r["start_us"])
        arms = {"zero": lambda r: 0.0, "pace": lambda r: r["pace_delta"], "categories": lambda r: fits[account,] @ [r[c] for c in QM.COST]}
        whole = blocks(late, "start_us", "end_us")
        block_loss = {a: [mean(loss(r, f(r)) for r in b) for b in whole] for a, f in arms.items()}
        for a, f in arms.items():
            g = got[account, a]
            assert g["rows"] == len(late) and g["loss"] == near(mean(loss(r, f(r)) for r in late)) and g["mae"] == near(mean(abs(r["end_used"] - r["start_used"] - f(r)) for r in late))
            assert g["blocks"] == len(whole) and g["block_loss"] == near(mean(block_loss[a]))
            residual = sorted(r["end_used"] - r["start_used"] - f(r) for r in late)
            assert g["middle_residual"] == near(residual[math.ceil(len(residual) * 0.5) - 1])
            covered = []
            for r in late:
                errors = [max(loss(x, f(x)) for x in b) for b in blocks([x for x in late if x["end_us"] < r["start_us"]], "start_us", "end_us")]
                if (radius := rank_radius(errors, floor=0.0)) is not None:
                    covered.append(loss(r, f(r)) <= radius + 1e-12)
            assert g["bands"] == len(covered) and (not covered or g["covered"] == near(mean(covered)))
            wins = sum(x < y for x, y in zip(block_loss[a], block_loss["pace"]))
            assert g["material_win"] == (mean(block_loss[a]) <= 0.9 * mean(block_loss["pace"]) and mean(block_loss["pace"]) - mean(block_loss[a]) >= 0.1 and 2 * wins > len(whole))


def test_training_takes_earlier_asserted_rows(spark):
    names = "account string, start_us long, end_us long"
    native = [("a", 1000 + 10 * i, 1010 + 10 * i) for i in range(30)] + [("b", 1000 + 10 * i, 1010 + 10 * i) for i in range(5)]
    asserted = [(k, 4 * i, 4 * i + 6) for k in "ab" for i in range(300)]
    got = records(S.training_policy(spark.createDataFrame(native, names), ["account"], spark.createDataFrame(asserted, names)))
    chosen, end = [], None
    for i in range(300):
        if 4 * i + 6 <= 1000 and (end is None or 4 * i >= end):
            chosen.append(4 * i)
            end = 4 * i + 6
    assert sorted(r["start_us"] for r in got if r["account"] == "a" and r["role"] == "asserted") == chosen[-120:]
    assert sum(r["account"] == "a" and r["role"] == "native" for r in got) == 20 and {r["role"] for r in got if r["account"] == "b"} == {"native"}


def test_rolling_comparison_chooses_on_the_first_part(cost):
    got = by(records(S.rolling_joint_comparison(cost, ["account"], {"categories": QM.COST})), "account")
    for (account,), rows in by(records(cost), "account").items():
        train, late = frozen(rows)
        ordered = sorted(rows, key=lambda r: (r["start_us"], r["end_us"]))
        a, z = min(r["start_us"] for r in late), max(r["start_us"] for r in late)

        def expanding(r):
            past = [x for x in ordered if x["end_us"] <= r["start_us"]]
            i, w = ridge([[x[c] for c in QM.COST] for x in past], [x["end_used"] - x["start_used"] for x in past], 1.0)
            return max(0.0, i + w @ [r[c] for c in QM.COST])

        mine = {r["candidate"]: r for r in got[account,]}
        for part, period in (("development", True), ("final", False)):
            side = [r for r in late if (r["start_us"] < a + (z - a) * 0.8) == period]
            want = mean(mean(loss(r, expanding(r)) for r in b) for b in blocks(side, "start_us", "end_us"))
            assert mine["expanding-categories"][f"{part}_loss"] == pytest.approx(want, rel=1e-4)
        wins = {c: r["development_loss"] for c, r in mine.items() if c not in ("pace", "zero") and r["development_loss"] + 0.1 < mine["pace"]["development_loss"] and r["development_loss"] < 0.9 * mine["pace"]["development_loss"]}
        assert [c for c, r in mine.items() if r["chosen"]] == [min(wins, key=wins.get) if wins else "pace"]


# --- M28, M29, M33


def test_composed_arms_share_their_targets(spark, cost):
    tokens = D.token_events(spark, SF)
    got = {r["account"]: r for r in records(S.composed_evaluation(cost, ["account"], QM.COST, tokens))}
    fits, events = weights_of(M.interval_ridge(cost, ["account"], QM.COST)), records(tokens.select("us", *QM.COST))
    for (account,), rows in by(records(cost), "account").items():
        _, late = frozen(rows)
        targets, missing = [], 0
        for r in late:
            mine = [e for e in events if r["start_us"] - 2 * HOUR < e["us"] <= r["start_us"]]
            if not mine:
                missing += 1
                continue
            hours = (r["end_us"] - r["start_us"]) / HOUR
            r["forecast"] = fits[account,] @ [sum(e[c] for e in mine) / 2 * hours for c in QM.COST]
            targets.append(r)
        whole = blocks(targets, "start_us", "end_us")
        g = got[account]
        assert g["targets"] == len(targets) and g["withheld_rows"] == missing and g["blocks"] == len(whole)
        assert g["forecast_work_loss"] == near(mean(mean(loss(r, r["forecast"]) for r in b) for b in whole)) and g["incumbent_loss"] == near(mean(mean(loss(r, r["incumbent_delta"]) for r in b) for b in whole))
    short = S.composed_evaluation(cost, ["account"], QM.COST, tokens, first=1000)
    assert {r["withheld"] for r in records(short)} == {""} and {r["targets"] for r in records(short)} == {0}


def test_selection_reasons(spark):
    def assess(rows, strict=False, as_of=None):
        t = spark.createDataFrame([("a", *r) for r in rows], "account string, origin_us long, outcome_us long, resets_us long, error double, loss double, pace_loss double, incumbent_loss double")
        return records(S.assess_selection(t, ["account"], as_of or rows[-1][1], strict))[0]

    good = [(i * 7 * HOUR, i * 7 * HOUR + HOUR, 10**18, 1.0 + i / 10, 1.0, 2.0, 2.0) for i in range(20)]
    g = assess(good, True)
    assert g["reasons"] == "" and g["blocks"] == 20 and g["radius"] == near(rank_radius([r[3] for r in good]))
    assert assess(good[:10])["reasons"] == "too-few-outcomes,too-few-independent"
    assert assess([(*r[:4], 1.95, 2.0, 2.0) for r in good])["reasons"] == "not-better-than-pace,not-better-than-incumbent"
    assert assess([*good[:-1], (*good[-1][:6], None)])["reasons"] == "unpaired"
    assert assess([*good[:-1], (*good[-1][:4], 3.0, 2.0, 2.0)], True)["reasons"] == "recent-block-lost"
    assert assess(good, as_of=good[-1][1] + 9 * HOUR)["reasons"] == "no-recent-outcome" and assess(good, as_of=good[-1][1] - 1)["reasons"] == "outcome-after-assessment"
    few = [(*r[:4], 0.0, 2.0, 5.0 if i < 9 else 0.0) for i, r in enumerate(good)]
    assert "no-majority-of-blocks" in assess(few)["reasons"]


def test_scenarios(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        h, roots, subs = float(rng.integers(3, 9)), int(rng.integers(1, 4)), int(rng.integers(0, 3))
        rows.append(("a", i * 10 * HOUR, int(i * 10 * HOUR + h * HOUR), 10**18, h, roots, subs, 0.1 * h + 3.0 * roots + float(rng.normal()) * 0.2))
    names = "account string, origin_us long, outcome_us long, resets_us long, lead_hours double, roots long, subagents long, moved double"
    ask = {"lead_hours": 6.0, "roots": 2.0, "subagents": 1.0}
    history = spark.createDataFrame(rows, names)
    g = records(S.scenario_estimate(history, ["account"], ask))[0]
    clip = lambda v: min(100, max(0, v))
    trial = []
    for r in rows:
        past = [x for x in rows if x[2] <= r[1]]
        if len(past) >= 6:
            a, w = ridge([x[4:7] for x in past], [x[7] for x in past], 10.0)
            trial.append((r, abs(r[7] - clip(sum(x[7] for x in past) / sum(x[4] for x in past) * r[4])), abs(r[7] - clip(a + w @ r[4:7]))))
    errors = []
    for i, (r, b, e) in enumerate(trial):
        past = [t for t in trial if t[0][2] <= r[1]]
        use = len(past) >= 6 and mean(t[2] for t in past) + 0.1 < 0.9 * mean(t[1] for t in past)
        errors.append({"origin_us": r[1], "outcome_us": r[2], "resets_us": r[3], "error": e if use else b, "hours": r[4]})
    a, w = ridge([x[4:7] for x in rows], [x[7] for x in rows], 10.0)
    like = [e for e in errors if 3 <= e["hours"] <= 12]
    radius = rank_radius([max(x["error"] for x in b) for b in blocks(like, "origin_us", "outcome_us")])
    assert g["trials"] == len(trial) and g["model"] == "ridge" and g["predicted"] == near(a + w @ [6, 2, 1]) and g["upper"] - g["predicted"] == near(radius) and g["reason"] is None
    assert records(S.scenario_estimate(history, ["account"], ask | {"roots": 9.0}))[0]["reason"] == "roots-outside-support"
    assert records(S.scenario_estimate(history.limit(5), ["account"], ask))[0]["reason"] == "too-few-rows"


# --- M39


def test_issued_scores(spark):
    rows = records(QM._issued(spark, SF))
    got = {(r["account"], r["horizon_hours"], r["reset_lead"]): r for r in records(QUERIES["m39_issued_scores"](spark, SF))}
    groups = collections.defaultdict(list)
    for r in rows:
        h = (r["resets_us"] - r["origin_us"]) / HOUR
        groups[r["account"], r["horizon_hours"], "0-2h" if h <= 2 else "2-24h" if h <= 24 else "over-24h"].append(r)
    assert set(groups) == set(got)
    for k, mine in groups.items():
        g, e = got[k], [r["error"] for r in mine if r["state"] == "matched" and not r["saturated"]]
        assert g["issued"] == len(mine) and g["ordinary"] == len(e) and g["states"] == ",".join(sorted(f"{s}:{n}" for s, n in collections.Counter(r["state"] for r in mine).items()))
        assert (g["mae"], g["signed"]) == (near(mean(map(abs, e))), near(mean(e))) if e else g["mae"] is None
        free = [r for b in blocks([r for r in mine if r["state"] == "matched"], "origin_us", "outcome_us") for r in b]
        assert g["independent"] == len(free) and (not free or g["accumulated"] == near(sum(r["error"] for r in free)))


def test_outcomes_of_issued_points(spark):
    base, m = 10**15, 60_000_000
    e = [(1, 0, base, 10.0, base + 50 * HOUR, base + m), (1, 1, base + 2 * HOUR, 30.0, base + 50 * HOUR, base + 2 * HOUR + m), (1, 2, base + 4 * HOUR, 100.0, base + 50 * HOUR, base + 4 * HOUR), (1, 3, base + 5 * HOUR, 100.0, base + 50 * HOUR, None), (1, 4, base + 6 * HOUR, 100.0, base + 50 * HOUR, base + 6 * HOUR - 1), (1, 5, base + 7 * HOUR, 100.0, base + 50 * HOUR, base + 8 * HOUR), (1, 6, base + 50 * HOUR, 100.0, base + 50 * HOUR, base + 50 * HOUR)]
    epochs = spark.createDataFrame([("a", *r) for r in e], "account string, epoch_id int, observation_id long, us long, used double, resets_us long, collected_us long")
    end, at = base + 50 * HOUR, lambda h: base + int(h * HOUR)
    points = {
        "matched": (base, at(2), end, 10.0, 65.0, 2.0, base + 1), "unconfirmed": (base, at(2), end, 10.0, 65.0, 2.0, None), "invalid-issue-clock": (base, at(2), end, 10.0, 65.0, 2.0, base - 1), "issued-at-or-after-target": (base, at(2), end, 10.0, 65.0, 2.0, at(2)),
        "confirmation-after-cutoff": (base, at(99), end, 10.0, 65.0, 2.0, at(80)), "point-unsupported": (base, at(2), end, 10.0, None, 2.0, base + 1), "anchor-not-forecastable": (base, at(2), end, 100.0, 65.0, 2.0, base + 1), "target-crosses-reset": (base, at(51), end, 10.0, 65.0, 51.0, base + 1),
        "target-immature": (base, at(70), at(80), 10.0, 65.0, 70.0, base + 1), "anchor-unavailable-or-revised": (base, at(2), end, 11.0, 65.0, 2.0, base + 1), "compatible-target-unavailable": (base, at(3), end, 10.0, 65.0, 3.0, base + 1),
        "outcome-collection-unknown": (base, at(5), end, 10.0, 65.0, 5.0, base + 1), "invalid-outcome-clock": (base, at(6), end, 10.0, 65.0, 6.0, base + 1), "outcome-collected-too-late": (base, at(7), end, 10.0, 65.0, 7.0, base + 1),
    }
    names = "account string, origin_us long, target_us long, resets_us long, anchor_used double, predicted double, horizon_hours double, confirmed_us long"
    for want, p in points.items():
        got = records(S.score_issued(spark.createDataFrame([("a", *p)], names), epochs, ["account"], at(60)))[0]
        assert got["state"] == want, (want, got)
    full = records(S.score_issued(spark.createDataFrame([("a", base, at(4), end, 10.0, 0.0, 4.0, base + 1), ("a", base, end, end, 10.0, 5.0, None, base + 2)], names), epochs, ["account"], at(60)))
    a, b = sorted(full, key=lambda r: r["target_us"])
    assert a["saturated"] and a["predicts_full"] and a["reaches_full"] and a["warning_minutes"] == near((4 * HOUR - 1) / 60e6) and b["state"] == "matched" and b["reaches_full"] and not b["predicts_full"]


# --- M40, M44 to M47, M49, M50


def test_threshold_study_scores_the_last_part(trials):
    got = by(records(M.threshold_study(trials, ["account"], {"default": M.Options(), "no-margin": M.Options(margin=0.0, margin_points=0.0)})), "account")
    for (account,), rows in by(records(trials), "account").items():
        a, z = min(r["origin_us"] for r in rows), max(r["origin_us"] for r in rows)
        dev = lambda r: r["origin_us"] < a + (z - a) * 0.8  # noqa: E731, B023
        for g in got[account,]:
            mine = [r for r in rows if r["model"] == g["model"]]
            assert g["trials"] == sum(not dev(r) for r in mine) and g["development"] == sum(map(dev, mine))
            assert g["mae"] == near(mean(r["error"] for r in mine if not dev(r))) if g["trials"] else g["mae"] is None
        assert sum(g["best"] for g in got[account,]) == any(map(dev, rows))


def scale_of(values, rows):
    """The scale that brings values closest to the rows' envelopes, by trying many."""
    def goal(s):
        return sum(max(0, r["lower"] - s * v, s * v - r["upper"]) ** 2 for v, r in zip(values, rows))

    lo, hi = 0.0, 50.0
    for _ in range(200):  # the goal is convex
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if goal(a) <= goal(b) else (a, hi)
    return (lo + hi) / 2, goal


def test_transfers_between_cohorts(cost):
    got = records(S.transfer_evaluation(cost, ["account"], "epoch_id", QM.COST, 8))
    lanes = by(records(cost), "account", "epoch_id")
    fits = weights_of(M.interval_ridge(cost, ["account", "epoch_id"], QM.COST, 8))
    assert got
    for g in got:
        train, late = frozen(lanes[g["account"], g["epoch_id"]], 8)
        assert max(r["end_us"] for r in lanes[g["account"], g["donor"]]) <= min(r["start_us"] for r in lanes[g["account"], g["epoch_id"]])
        value = lambda r: fits[g["account"], g["donor"]] @ [r[c] for c in QM.COST]  # noqa: E731, B023
        whole = blocks(late, "start_us", "end_us")
        assert g["reused"] == near(mean(mean(loss(r, value(r)) for r in b) for b in whole)) and g["local"] == near(mean(mean(loss(r, fits[g["account"], g["epoch_id"]] @ [r[c] for c in QM.COST]) for r in b) for b in whole))
    pairs = {(g["account"], g["epoch_id"], g["donor"]) for g in got}
    assert all(d != c for _, c, d in pairs)


def test_scales_are_the_closest(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v), float(2 * v + e), float(2 * v + e + 1)) for v, e in zip(rng.integers(0, 20, 20), rng.normal(size=20))]
    got = records(S._scales(spark.createDataFrame(rows, "k string, v double, lower double, upper double"), ["k"], "v"))[0]["scale"]
    want, goal = scale_of([r[1] for r in rows], [{"lower": r[2], "upper": r[3]} for r in rows])
    assert goal(got) <= goal(want) + 1e-6
    zero = S._scales(spark.createDataFrame([("a", 0.0, 1.0, 2.0)], "k string, v double, lower double, upper double"), ["k"], "v")
    assert records(zero)[0]["scale"] is None


def test_aligned_meters_of_one_scale(spark, cost):
    """Where the second meter is the first one times three, the shared scale is three and costs nothing more."""
    o = cost.select("account", "start_us", "end_us", "resets_us", *QM.COST, *(F.col(c).alias(f"left_{c}") for c in ("lower", "upper")), S.moved().alias("left_moved"), *((3 * F.col(c)).alias(f"right_{c}") for c in ("lower", "upper")), (3 * S.moved()).alias("right_moved"))
    for g in records(S.aligned_window_study(o, ["account"], QM.COST)):
        assert g["scale"] == pytest.approx(3 if g["meter"] == "right" else 1 / 3, rel=0.15) and g["shared"] == pytest.approx(g["separate"], rel=0.25, abs=0.3)


def test_scores_on_the_rows_after_the_scale(cost):
    got = {r["account"]: r for r in records(S.tt_evaluation(cost, ["account"], QM.COST, 15))}
    fits = weights_of(M.interval_ridge(cost, ["account"], QM.COST, 15))
    for (account,), rows in by(records(cost), "account").items():
        rows.sort(key=lambda r: r["start_us"])
        late = [r for r in rows[30:] if r["start_us"] >= max(x["end_us"] for x in rows[15:30])]
        g = got[account]
        value = [g["scale"] * (fits[account,] @ [r[c] for c in QM.COST]) for r in late]
        assert g["rows"] == len(late) and g["cumulative_error"] == near(sum(value) - sum(r["end_used"] - r["start_used"] for r in late)) and g["least_error"] <= g["cumulative_error"] <= g["greatest_error"]
        assert g["zero_loss"] == near(mean(mean(loss(r, 0) for r in b) for b in blocks(late, "start_us", "end_us")))
        best, goal = scale_of([fits[account,] @ [r[c] for c in QM.COST] for r in rows[15:30]], rows[15:30])
        assert goal(g["scale"]) <= goal(best) + 1e-3


def test_sessions_are_scored_against_the_meter(spark, cost):
    h = M.activity_hurdle(D.token_events(spark, SF).withColumn("all", F.lit("all")), ["all"], HOUR)
    got = {r["account"]: r for r in records(S.session_quota_evaluation(h, cost, ["account"], HOUR))}
    hurdles = sorted(records(h), key=lambda r: r["origin_us"])
    total = cost.withColumn("all_tokens", sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])).cast("double"))
    price = weights_of(M.interval_ridge(total, ["account"], ["all_tokens"]))
    for (account,), rows in by(records(cost), "account").items():
        _, late = frozen(rows)
        errors, withheld = [], 0
        for r in late:
            mine = [x for x in hurdles if x["origin_us"] <= r["start_us"] < x["origin_us"] + HOUR]
            if not mine or mine[-1]["conditional_mean"] is None:
                withheld += 1
                continue
            value = mine[-1]["conditional_mean"] * (r["end_us"] - r["start_us"]) / HOUR * price[account,][0] * mine[-1]["probability"]
            errors.append(abs(value - (r["end_used"] - r["start_used"])))
        assert got[account]["trials"] == len(errors) and got[account]["withheld"] == withheld and got[account]["expected_mae"] == near(mean(errors))


def test_paths_use_only_bins_before_their_origin(spark):
    rows = records(QUERIES["m49_resample_paths"](spark, SF))
    bins = by(records(D.token_events(spark, SF).groupBy("model", (F.ceil(F.col("us") / (300_000_000)) * 300_000_000).alias("at")).agg(F.sum("total").cast("long").alias("t"))), "model")
    known = {k: {r["at"]: r["t"] for r in v} for k, v in bins.items()}
    order = {k: sorted(v) for k, v in known.items()}
    for (m, o, p), path in by(rows, "model", "origin_us", "path").items():
        path.sort(key=lambda r: r["step"])
        before = [a for a in order[m,] if a <= o]
        assert len(path) == 24 and all(r["at"] <= o and r["t"] == known[m,][r["at"]] for r in path)
        for i in range(0, 24, 3):  # a run is of neighbouring bins
            at = [before.index(r["at"]) for r in path[i : i + 3]]
            assert all(b == min(a + 1, len(before) - 1) for a, b in itertools.pairwise(at))
    crossings = {(r["model"], r["origin_us"]): r for r in records(QUERIES["m50_first_crossing"](spark, SF))}
    for (m, o), mine in by(rows, "model", "origin_us").items():
        hits = []
        for path in by(mine, "path").values():
            path.sort(key=lambda r: r["step"])
            sums = list(itertools.accumulate(r["t"] for r in path))
            hits += [next(i for i, s in enumerate(sums) if s >= 100_000)] if sums[-1] >= 100_000 else []
        c = crossings[m, o]
        assert (c["paths"], c["crossed"], c["unresolved"]) == (16, len(hits), 0) and c["middle"] == (sorted(hits)[math.ceil(len(hits) / 2) - 1] if hits else None)


# --- W11, W12, W22, M27, A22


def test_change_points(spark):
    rng = np.random.default_rng(9)
    errors = [float(x) for x in np.concatenate([rng.normal(5, 0.5, 30), rng.normal(15, 0.5, 30)])]
    rows = [("a", i, e, e if i % 2 else e + 1, -e) for i, e in enumerate(errors)] + [("b", i, float(rng.normal(5, 0.5)), 0.0, 0.0) for i in range(60)]
    t = spark.createDataFrame(rows, "k string, i long, e double, same double, against double")

    def brute(values):
        best = None
        for i in range(8, len(values) - 7):
            left, right = values[max(0, i - 24) : i], values[i : i + 24]
            cost = lambda v, m: sum(abs(x - m) for x in v)
            med = np.median
            whole, split = cost(left + right, med(left + right)), cost(left, med(left)) + cost(right, med(right))
            shift = med(right) - med(left)
            if abs(shift) > max(2, 3 * med([abs(x - med(left)) for x in left])) and whole - split >= 0.25 * whole and (best is None or whole - split > best[2]):
                best = i, shift, whole - split
        return best

    got = {r["k"]: r for r in records(W.change_point(t, ["k"], "i", "e"))}
    want = brute(errors)
    assert set(got) == {"a"} and (got["a"]["boundary"], got["a"]["shift"], got["a"]["gain"]) == (want[0], near(want[1]), near(want[2])) and want[0] == 30
    assert [r["k"] for r in records(W.change_point(t, ["k"], "i", "e", control="same"))] == ["a"] and records(W.change_point(t, ["k"], "i", "e", control="against")) == []
    report = {r["k"]: r["marker"] for r in records(M.regime_report(t.withColumnsRenamed({"i": "origin_us", "e": "error"}), ["k"]))}
    assert report == {"a": "Shift", "b": "Stable"}


def test_legacy_pace_and_evidence(spark, cost):
    rows = by(records(QM._epochs(spark, SF).where("epoch_id is not null")), "account", "epoch_id")
    got = records(QUERIES["w12_legacy_pace"](spark, SF))
    want = {}
    for lane in rows.values():
        rate = last = None
        for r in sorted(lane, key=lambda r: r["us"]):
            if last is not None and r["us"] > last["us"]:
                now = max(0.0, (r["used"] - last["used"]) / ((r["us"] - last["us"]) / HOUR))
                rate = now if rate is None else 0.25 * now + 0.75 * rate
            last = r
            want[r["observation_id"]] = rate or 0.0
    key = "legacy_ewma"
    assert len(got) == len(want) and all(r[key] == pytest.approx(want[r["observation_id"]], abs=1e-5) for r in got)
    c = cost.withColumn("residual", F.col("end_used") - F.col("start_used") - F.col("pace_delta"))
    for g in records(W.evidence_support(c, ["account"], "residual")):
        whole = blocks([r for r in records(c) if r["account"] == g["account"]], "start_us", "end_us")
        means = [mean(r["residual"] for r in b) for b in whole]
        n, dev = len(means), np.array(means) - np.mean(means)
        total = 0.0
        for k in range(1, max(1, min(10, n // 3)) + 1):
            x = float((dev[k:] * dev[: n - k]).sum() / (dev**2).sum())
            if x <= 0:
                break
            total += x
        assert (g["blocks"], g["independent"]) == (n, sum(map(len, whole))) and g["effective"] == near(min(n, max(1, n / (1 + 2 * total))))


def test_basis(spark):
    from ledgerloom.operators import pricing

    rows = [("m", "uncached", 1.5), ("m", "output", 2.0), ("n", "output", 4.0)]
    make = lambda r: spark.createDataFrame(r, "model string, category string, weight double").withColumn("weight", F.col("weight").cast("decimal(18,6)"))
    a, b = (records(pricing.basis_id(make(r), ["model"]))[0] for r in (rows, rows[::-1]))
    assert a == b and float(a["normaliser"]) == 7.5 and a["cells"] == 3
    assert records(pricing.basis_id(make([*rows[:2], ("n", "output", 4.5)]), ["model"]))[0]["basis_id"] != a["basis_id"]
    lost = lambda new: [(r["model"], r["category"]) for r in records(pricing.extends_basis(make(rows), make(new), ["model"]))]
    assert lost([*rows, ("o", "output", 1.0)]) == [] and lost([("m", "uncached", 1.5), ("m", "output", 2.5)]) != []


def test_plan_fits(spark, cost):
    got = records(QUERIES["m35_plan_fit"](spark, SF))
    fits, events = weights_of(M.interval_ridge(cost, ["account"], QM.COST)), records(D.token_events(spark, SF).select("us", *QM.COST))
    for r in got:
        mine = [e for e in events if r["us"] - 2 * HOUR < e["us"] <= r["us"]]
        value = fits[r["account"],] @ [sum(e[c] for e in mine) / 2 for c in QM.COST]
        assert r["cost"] == pytest.approx(value, rel=1e-4, abs=1e-6) and (r["fit"] == "fits") == (max(r["cost"], r["pace_use"]) <= r["left"])
