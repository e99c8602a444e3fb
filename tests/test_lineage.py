"""The three readings of counters (W2) against a plain walk through each file's observations."""

import random

import pytest
from ledgerloom.operators import lineage as L
from ledgerloom.operators.sequence import reduce_counters, reduce_step
from ledgerloom.plans.queries_growth import _delivered
from ledgerloom.sources import adapters, shared
from pyspark.sql import functions as F

COUNTERS = "struct<input:long,cached:long,cache_write:long,output:long,reasoning:long,total:long>"
ROW = f"session_id int, arrival int, source_event_id int, us long, total {COUNTERS}, last {COUNTERS}"


def counters(t):
    return (t * 8 // 10, t // 2, t // 10, t - t * 8 // 10, t // 10, t)


def observations(seed, lines, n):
    """Counters of several interleaved lines of work, with retries, missing and incomplete counters."""
    rng = random.Random(seed)
    out = []
    for session in range(4):
        at = [rng.randrange(1, 50) * 1000 for _ in range(lines)]
        for i in range(n):
            k = rng.randrange(lines)
            step = rng.choice([0, 1, 7, 30, 500])
            at[k] = rng.randrange(100) if rng.random() < 0.02 else at[k] + step
            total = None if rng.random() < 0.05 else counters(at[k]) if rng.random() > 0.05 else (*counters(at[k])[:4], None, at[k])
            out.append([session, i, i, i * 1000, total, counters(step) if rng.random() < 0.7 else None])
            if rng.random() < 0.1:
                out.append([*rng.choice([r for r in out if r[0] == session])])
                out[-1][1] = i
    for n, r in enumerate(out):
        r[1] = n
    return out


def walked(rows):
    files = {}
    for s, _, ident, us, total, last in sorted(rows, key=lambda r: r[1]):
        f = files.setdefault(s, {"seen": set(), "heads": [], "high": 0, "prev": None, "red": None, "sums": [0, 0, 0], "retries": 0, "incomplete": 0, "drops": 0, "changes": 0, "buckets": {}})
        whole, led = (x is not None and all(v is not None and v >= 0 for v in x) for x in (total, last))
        a = b = c = 0
        if ident in f["seen"]:
            name = "occurrence-retry"
            f["retries"] += 1
        else:
            if not whole:
                name = "unusable-cumulative"
            elif f["prev"] is None:
                name = "first-cumulative"
            elif total[5] < f["high"]:
                name = "below-watermark/" + ("falling" if total[5] < f["prev"][5] else "repeated" if total[5] == f["prev"][5] else "recovering")
            else:
                name = "at-watermark" if total[5] == f["high"] else "above-watermark"
            name += "/usable-last" if led else "/unusable-last"
            f["red"], decision = reduce_step(f["red"], (ident, us, total, last))
            a = decision[-1]
            if not whole:
                f["incomplete"] += 1
            else:
                t, heads = total[5], f["heads"]
                f["changes"] += f["prev"] is not None and f["prev"][5] == t and f["prev"] != total
                f["prev"], b = total, max(0, t - f["high"])
                if led and last[5] <= t:
                    if t not in heads:
                        if t - last[5] in heads:
                            heads.remove(t - last[5])
                        c = last[5]
                else:
                    f["drops"] += t < f["high"]
                    c = b
                if t in heads:
                    heads.remove(t)
                heads.append(t)
                del heads[:-32]
                f["high"] = max(f["high"], t)
        f["seen"].add(ident)
        f["sums"] = [x + y for x, y in zip(f["sums"], (a, b, c))]
        bucket = f["buckets"].setdefault(name, [0, 0, 0, 0, 0])
        f["buckets"][name] = [x + y for x, y in zip(bucket, (1, a != b or a != c, a, b, c))]
    return files


@pytest.mark.parametrize(("lines", "n"), [(1, 60), (3, 200), (50, 400)])
def test_three_totals_and_their_transitions(spark, lines, n):
    rows = observations(lines, lines, n)
    steps = L.lineage_steps(spark.createDataFrame(rows, ROW).repartition(5), order=("arrival",)).persist()
    want = walked(rows)
    got = {r.session_id: r for r in L.lineage_totals(steps).collect()}
    assert got.keys() == want.keys()
    for s, f in want.items():
        r = got[s]
        assert [r.reducer_total, r.watermark_total, r.lineage_total] == f["sums"]
        assert (r.retries, r.incomplete_counters, r.totals_only_drops, r.category_changes) == (f["retries"], f["incomplete"], f["drops"], f["changes"])
        assert r.agree == (len(set(f["sums"])) == 1) and r.ambiguous == (f["drops"] > 0)
    assert max(r.most_heads for r in got.values()) == 32 if lines == 50 else True
    buckets = {}
    for f in want.values():
        for name, v in f["buckets"].items():
            buckets[name] = [x + y for x, y in zip(buckets.get(name, [0] * 5), v)]
    assert {r.transition: [*r[1:]] for r in L.lineage_transitions(steps).collect()} == buckets
    assert any(v[1] for v in buckets.values()) or lines == 1


def test_interleaved_lines_are_counted_whole(spark):
    """Two lines of work in one file: only lineages see all usage, the watermark sees the higher line alone."""
    rows, at = [], [1000, 90_000]
    for i in range(40):
        at[i % 2] += 10
        rows.append((0, i, i, i, counters(at[i % 2]), counters(10)))
    r = L.lineage_totals(L.lineage_steps(spark.createDataFrame(rows, ROW), order=("arrival",))).first()
    assert (r.lineage_total, r.watermark_total, r.most_heads, r.agree) == (400, 90_000 + 200, 2, False)


def test_no_observations(spark):
    assert L.lineage_transitions(L.lineage_steps(spark.createDataFrame([], ROW))).collect() == []


def test_tasks_of_a_walk_grow_with_its_rows(spark, monkeypatch):
    """Rows of small tables are few bytes, which adaptive execution would join into one task."""
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 500)
    sf = "/root/testdata/sf0.01"
    for steps in (_delivered(spark, sf), reduce_counters(adapters.token_observations(spark, sf))):
        tasks = [r["count"] for r in steps.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(tasks) > 15 and max(tasks) < 2_000 and sum(tasks) >= 10_000


def test_tasks_for_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEWEST_ROWS", 10)
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 1000)
    assert [shared.tasks_for(spark.range(n)) for n in (0, 9, 45, 500, 50_500)] == [1, 1, 4, 8, 50]


def test_observations_are_derived_once(spark):
    """A copy delivered later is a row beside its first one; the same rows as those of a union with a second derivation."""
    sf = "/root/testdata/sf0.001"
    steps = _delivered(spark, sf)
    assert steps._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    o = adapters.token_observations(spark, sf).withColumn("arrival", 2 * F.col("source_event_id"))
    twice = L.lineage_steps(o.unionByName(o.where("source_event_id % 23 = 0").withColumn("arrival", F.col("arrival") + 81)), order=("arrival",))
    of = lambda rows: sorted(map(repr, rows.select(steps.columns).collect()))
    assert of(steps) == of(twice)
    retries = steps.where(F.col("transition") == L.RETRY)
    assert retries.count() == steps.count() - o.count() == steps.where("source_event_id % 23 = 0").count() / 2 > 0
