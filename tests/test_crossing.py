"""First crossings over several windows and resets (M50) against plain path arithmetic."""

import math
import random

from ledgerloom.operators import crossing as C
from pyspark.sql import functions as F

MINUTE = 60_000_000
WINDOWS = ("FiveHour", "Weekly")


def scenario(rng):
    """One origin: budgets, declared resets, paths of steps with costs for both windows."""
    origin, budgets, resets = rng.randrange(10) * MINUTE, {}, {}
    for w in WINDOWS:
        at = origin + rng.choice([30, 60, 90, 400]) * MINUTE
        budgets[w] = (rng.choice([0.0, 4.0, 10.0, 40.0]) if rng.random() < 0.3 else 30.0, at)
        resets[w] = []
        for _ in range(rng.randrange(3)):
            nxt = at + rng.choice([20, 60]) * MINUTE
            resets[w].append((at, nxt, rng.choice([0.0, 5.0, 8.0, 50.0])))
            at = nxt
    paths = []
    for _ in range(8):
        t, steps = origin, []
        while t < origin + 125 * MINUTE:
            to = t + rng.choice([5, 10, 20]) * MINUTE
            steps.append((t, to, {w: rng.choice([0.0, 1.0, 2.0, 5.0, 10.0]) if rng.random() > 0.004 else float("nan") for w in WINDOWS}))
            t = to
        paths.append(steps)
    return origin, budgets, resets, paths


def plain(origin, budgets, resets, steps, through):
    support = min(resets[w][-1][1] if resets[w] else budgets[w][1] for w in WINDOWS)
    cap = min(support, through)
    left, end, n = {w: budgets[w][0] for w in WINDOWS}, {w: budgets[w][1] for w in WINDOWS}, dict.fromkeys(WINDOWS, 0)

    def opened(at):
        for w in WINDOWS:
            if n[w] < len(resets[w]) and resets[w][n[w]][0] == at:
                _, end[w], left[w] = resets[w][n[w]]
                n[w] += 1

    empty = lambda: [w for w in WINDOWS if left[w] == 0]
    if empty():
        return ("crossed", origin, origin, origin, empty(), None)
    for a0, b0, costs in steps:
        if a0 >= cap:
            break
        if any(not math.isfinite(c) or c < 0 for c in costs.values()):
            return ("unresolved", a0, None, None, [], "invalid-step-cost")
        stop = min(b0, cap)
        cuts = sorted({a0, stop} | {t for w in WINDOWS for t in [budgets[w][1], *(r[0] for r in resets[w]), *(r[1] for r in resets[w])] if a0 < t < stop})
        for a, b in zip(cuts, cuts[1:]):
            opened(a)
            if empty():
                return ("crossed", a, a, a, empty(), None)
            met, tie, sure = [], False, False
            for w in WINDOWS:
                cost = costs[w] * (b - a) / (b0 - a0)
                if cost >= left[w]:
                    met.append(w)
                    exact = b in (end[w], support) and abs(cost - left[w]) <= 1e-12
                    tie, sure = tie or exact, sure or not exact
                left[w] = max(0.0, left[w] - cost)
            if sure:
                return ("crossed", b, a, b, met, None)
            if tie:
                return ("unresolved", b, None, None, [], "reset-order-tie")
    opened(cap)
    if empty():
        return ("crossed", cap, cap, cap, empty(), None)
    return ("unresolved", cap, None, None, [], "unsupported-reset") if support <= through else ("no-crossing", through, None, None, [], None)


def test_any_windows_and_resets(spark):
    rng = random.Random(11)
    all_, budgets, resets, steps = [scenario(rng) for _ in range(60)], [], [], []
    for k, (origin, b, r, paths) in enumerate(all_):
        budgets += [(k, w, origin, *b[w]) for w in WINDOWS]
        resets += [(k, w, at, nxt, left, origin) for w in WINDOWS for at, nxt, left in r[w]]
        resets.append((k, "Weekly", 0, 10**12, 77.0, origin + 1))  # declared too late
        steps += [(k, p, a, z, c) for p, path in enumerate(paths) for a, z, c in path]
    b = spark.createDataFrame(budgets, "k int, window string, origin_us long, remaining double, reset_us long")
    r = spark.createDataFrame(resets, "k int, window string, at_us long, next_us long, remaining double, declared_us long")
    s = spark.createDataFrame(steps, "k int, path int, from_us long, to_us long, costs map<string,double>")
    outcomes = C.crossing_outcomes(s, b, r, ["k"], F.col("origin_us") + 120 * MINUTE).persist()
    got = {(x.k, x.path): (x.state, x.known_through_us, x.from_us, x.through_us, x.windows, x.reason) for x in outcomes.collect()}
    want = {(k, p): plain(o, b, r, path, o + 120 * MINUTE) for k, (o, b, r, paths) in enumerate(all_) for p, path in enumerate(paths)}
    assert got == want
    assert {x[0] for x in want.values()} == {"crossed", "no-crossing", "unresolved"} and {x[5] for x in want.values()} == {None, "invalid-step-cost", "unsupported-reset", "reset-order-tie"}
    for x in C.crossing_report(outcomes, ["k"]).collect():
        own = [v for (k, _), v in want.items() if k == x.k]
        times = sorted((v[3] - all_[x.k][0]) / MINUTE for v in own if v[0] == "crossed")
        assert (x.paths, x.crossed, x.no_crossing, x.unresolved) == (8, len(times), sum(v[0] == "no-crossing" for v in own), sum(v[0] == "unresolved" for v in own))
        assert abs(x.crossed_share + x.no_crossing_share + x.unresolved_share - 1) < 1e-12
        assert [x.p10_minutes, x.p50_minutes, x.p90_minutes] == [times[math.ceil(len(times) * q) - 1] if times else None for q in (0.1, 0.5, 0.9)]
    counted = {(x.k, x.window): x.paths for x in C.crossing_windows(outcomes, ["k"]).collect()}
    assert counted == {(k, w): n for k in range(60) for w in WINDOWS if (n := sum(w in v[4] for (k2, _), v in want.items() if k2 == k and v[0] == "crossed"))}


def test_no_paths(spark):
    b = spark.createDataFrame([], "k int, window string, origin_us long, remaining double, reset_us long")
    r = spark.createDataFrame([], "k int, window string, at_us long, next_us long, remaining double, declared_us long")
    s = spark.createDataFrame([], "k int, path int, from_us long, to_us long, costs map<string,double>")
    assert C.crossing_report(C.crossing_outcomes(s, b, r, ["k"], F.col("origin_us") + 1), ["k"]).collect() == []
