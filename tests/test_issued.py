"""Issued forecasts: every reading is scored, as plain Python does and as the SQL does."""

import collections

from ledgerloom.plans.catalog import ORACLE, QUERIES
from ledgerloom.plans.queries_meter import AS_OF, HOUR, MINUTE, _epochs
from ledgerloom.sources import adapters as D
from oracle import connect

SF = "/root/testdata/sf0.001"


def state(r, known, lanes):
    o, t, k = r.us, r.us + 2 * HOUR, r.k
    conf = None if k % 33 == 0 else o + 3 * HOUR if k % 37 == 0 else o - 1 if k % 41 == 0 else r.collected_us
    if conf is None:
        return "unconfirmed"
    if conf < o:
        return "invalid-issue-clock"
    if conf >= t:
        return "issued-at-or-after-target"
    if conf > AS_OF:
        return "confirmation-after-cutoff"
    if k % 31 == 0:
        return "point-unsupported"
    if not 0 <= r.used < 100:
        return "anchor-not-forecastable"
    if t > r.resets_us:
        return "target-crosses-reset"
    if t > AS_OF:
        return "target-immature"
    a = known.get((r.account, o))
    if a is None or a.used != r.used or abs(a.resets_us - r.resets_us) > 1_000_000:
        return "anchor-unavailable-or-revised"
    found = next((x for x in lanes[r.account, a.epoch_id] if x.us >= t), None)
    if found is None or found.us > t + 5 * MINUTE:
        return "compatible-target-unavailable"
    if found.collected_us < found.us:
        return "invalid-outcome-clock"
    return "outcome-collected-too-late" if found.collected_us > found.us + 5 * MINUTE else "matched"


def test_every_reading_is_scored(spark):
    known, lanes = {}, collections.defaultdict(list)
    for r in sorted(_epochs(spark, SF).where("epoch_id is not null").collect(), key=lambda r: (r.us, r.observation_id)):
        if r.us <= AS_OF and r.collected_us <= AS_OF:
            known[r.account, r.us] = r
    for r in known.values():
        lanes[r.account, r.epoch_id].append(r)
    rows = D.quota_snapshots(spark, SF).where("used is not null").collect()
    want = collections.Counter((r.account, r.us, state(r, known, lanes)) for r in rows)
    got = collections.Counter(tuple(r) for r in QUERIES["m39_score_issued"](spark, SF).select("account", "origin_us", "state").collect())
    assert got == want and len({s for _, _, s in want}) > 6
    sql = collections.Counter(connect(SF).execute(f"SELECT account, origin_us, state FROM ({ORACLE['m39_score_issued']})").fetchall())
    assert sql == want
