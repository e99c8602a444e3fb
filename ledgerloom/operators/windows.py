"""Window operators of the meter and of activity (W operators): eligibility, resets, burn, pace, overlap, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import activity_state, authority, median, valid_percent
from .filters import COHORT, cohort_key
from .joins import levels_in, range_join
from .sequence import HOUR_US, SECOND_US, chronological_blocks, fold, fold_ranges, reading_order

STREAM = ["provider", "profile", "kind", "source", "account"]


def describe_history(quota: DataFrame, as_of: int, provider: str = "codex") -> DataFrame:
    """Each reading with its cohort, eligibility and the first reason that applies."""
    auth = authority(F.col("source"))
    q = quota.withColumn("cohort", cohort_key()).withColumn("_embedded", auth == "EmbeddedObservation")
    tie = Window.partitionBy("cohort", "us")
    reading = F.struct("used", "window_minutes", "resets_us")
    q = q.withColumn("_kinds", F.size(F.collect_set(F.to_json(reading)).over(tie))).withColumn("_nth", F.row_number().over(tie.orderBy("observation_id")))
    early = (
        F.when((F.col("provider") != provider) | (auth == "Unknown"), "unsupported-source").when(F.col("kind") == "Unknown", "unsupported-window")
        .when(F.col("us") > as_of, "future-event").when(F.col("us").isNull(), "missing-event-time")
        .when(~valid_percent(F.col("used")) | (F.coalesce("window_minutes", F.lit(0)) <= 0) | F.col("resets_us").isNull() | (F.col("resets_us") < F.col("us")), "invalid-window")
        .when(F.col("_embedded") & (F.col("observation_id").isNull() | F.col("session").isNull()), "legacy-missing-provenance")
        .when(F.col("_kinds") > 1, "same-time-conflict").when(F.col("_nth") > 1, "same-time-repeat")
    )
    q = q.withColumn("_early", early)
    # what an embedded reading may repeat: the last row before it that is no repeat, if that one is sound
    order = Window.partitionBy("cohort").orderBy("us", "observation_id")
    before = F.last(F.when(F.coalesce(F.col("_early"), F.lit("")) != "same-time-repeat", F.struct(F.col("_early").isNull().alias("sound"), reading.alias("r"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cached = F.col("_embedded") & F.coalesce(before["sound"] & (before["r"] == reading), F.lit(False))
    q = q.withColumn("reason", F.coalesce("_early", F.when(cached, "possibly-cached-repeat").when(F.col("_embedded"), "historical-embedded-account-unverified").otherwise("historical-app-server")))
    return q.withColumn("eligible", F.col("reason").startswith("historical-")).drop("_embedded", "_kinds", "_nth", "_early")


def replay_rows(decisions: DataFrame) -> DataFrame:
    """Rows that are not eligible stay as boundaries without a value."""
    kept = F.col("eligible") | F.col("reason").isin("same-time-conflict", "invalid-window", "missing-event-time")
    return decisions.where(kept).withColumn("used", F.when(F.col("eligible"), F.col("used")))


def pace_rows(rows: DataFrame, selected: Column) -> DataFrame:
    """Other regimes of the same meter cut the series too."""
    return rows.withColumn("used", F.when(cohort_key() == selected, F.col("used")))


def watermark_totals(observations: DataFrame, file: str = "session_id") -> DataFrame:
    """Per file the reducer's total beside that of a plain high watermark."""
    from .sequence import reduce_counters

    reduced = reduce_counters(observations, file).groupBy(file).agg(F.sum("delta_total").cast("long").alias("reducer_total"))
    total = F.col("total.total")
    high = F.max(total).over(Window.partitionBy(file).orderBy("us", "source_event_id").rowsBetween(Window.unboundedPreceding, -1))
    marks = observations.withColumn("_up", F.greatest(F.lit(0), total - F.coalesce(high, F.lit(0)))).groupBy(file).agg(F.sum("_up").cast("long").alias("watermark_total"))
    return reduced.join(marks, file).withColumn("agree", F.col("reducer_total") == F.col("watermark_total"))


RESET_TOLERANCE_US = 1800 * SECOND_US


def reset_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """state: (last used and reset, least and greatest reset of its window); row: (used, resets) -> whether the window changed, if both readings are known."""
    before, low, high = state
    used, resets = row
    if before is None:
        return ((used, resets), resets, resets), (None,)
    if before[0] is None or used is None:
        return ((used, resets), resets, resets), (None,)
    near = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) <= SECOND_US)
    changed = not near(before[1], resets) or (resets is not None and low is not None and high is not None and not (near(resets, low) and near(resets, high)))
    if changed:
        low = high = resets
    elif resets is not None:
        low, high = min(resets, low if low is not None else resets), max(resets, high if high is not None else resets)
    return ((used, resets), low, high), (changed,)


def _reset_pair(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """reset_step with the reading before: its time, used and reset."""
    (last, inner), (us, used, resets) = state, row
    before = inner[0] or (None, None)
    inner, (changed,) = reset_step(inner, (used, resets))
    return (us, inner), (last, *before, changed)


def detect_resets(quota: DataFrame, tolerance_us: int = RESET_TOLERANCE_US, long_streams: bool = False) -> DataFrame:
    """Adjacent readings of a cohort that show a reset, with class, confidence and an id of the pair.  long_streams: a cohort may
    hold a large share of all rows."""
    q = quota.where(F.col("kind").isin("FiveHour", "Weekly")).withColumn("cohort", cohort_key()).withColumn("_c", F.xxhash64("cohort"))
    walk = fold_ranges if long_streams else fold
    q = walk(q, ["_c"], ["us", "observation_id"], ["us", "used", "resets_us"], lambda: (None, (None, None, None)), _reset_pair, "_us long, _used double, _resets long, _changed boolean")
    drop, changed = F.col("_used") - F.col("used"), F.col("_changed")
    due = F.coalesce(F.col("us").between(F.col("_resets") - tolerance_us, F.col("_resets") + tolerance_us), F.lit(False))
    later = F.coalesce(F.col("resets_us") > F.col("_resets"), F.lit(False))
    kind = (
        F.when(changed & (drop >= 1) & due, "ExpectedReset").when(changed & (drop >= 50), "FullReset").when(changed & (drop >= 1), "UnusualReset").when(changed & (drop < 1) & later, "ReanchoredWindow")
        .when(~changed & (drop >= 50), "FullReset").when(~changed & (drop >= 5), "UnusualReset")
    )
    sure = (
        F.when(changed & (drop >= 1) & due, F.least(F.lit(0.98), 0.88 + F.least(drop, F.lit(50.0)) / 500)).when(changed & (drop >= 50), 0.78).when(changed & (drop >= 5), 0.68).when(changed & (drop >= 1), 0.55)
        .when(changed, F.when(F.col("_resets") <= F.col("us"), 0.92).otherwise(0.72)).when(drop >= 50, 0.62).otherwise(0.5)
    )
    q = q.where(F.col("_used").isNotNull() & F.col("used").isNotNull()).withColumn("classification", kind).where("classification is not null")
    ident = F.sha2(F.to_json(F.struct("cohort", "_us", "us"), {"ignoreNullFields": "false"}), 256)
    at = F.when(F.col("classification") == "ExpectedReset", F.col("_resets")).otherwise(F.col("us"))
    return q.select(ident.alias("event_id"), "account", "kind", F.col("_us").alias("previous_us"), "us", at.alias("effective_us"), F.col("_used").alias("previous_used"), "used", "classification", sure.alias("confidence"))


def burn_intervals(quota: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Positive moves between adjacent readings of one reset window."""
    w = Window.partitionBy(*keys).orderBy("us", "observation_id")
    q = quota.withColumns({"start_us": F.lag("us").over(w), "_used": F.lag("used").over(w), "_resets": F.lag("resets_us").over(w), "_window": F.lag("window_minutes").over(w)})
    ok = (F.col("us") > F.col("start_us")) & (F.col("resets_us") == F.col("_resets")) & (F.col("window_minutes") == F.col("_window")) & (F.col("used") > F.col("_used"))
    return q.where(ok).select(*keys, "start_us", F.col("us").alias("end_us"), F.col("_used").alias("start_used"), F.col("used").alias("end_used"), (F.col("used") - F.col("_used")).alias("delta"), "resets_us", "observation_id")


def burn_interval_aggregate(intervals: DataFrame, events: DataFrame, edges: DataFrame, compactions: DataFrame) -> DataFrame:
    """What happened inside each interval; the dominant model and effort, and a confidence."""
    from .aggregates import with_role

    spans = intervals.select("observation_id", "start_us", "end_us")
    e = with_role(events.where("quality = 'Valid'"), edges).select("session_id", "us", "total", "model", "effort", "role")
    levels = levels_in(spans, "start_us", "end_us", HOUR_US)
    hits = range_join(e, spans, [], "us", "start_us", "end_us", HOUR_US, closed="right", levels=levels)
    cells = hits.groupBy("observation_id", "model", "effort").agg(F.sum("total").cast("long").alias("t"), F.sum(F.when(F.col("role") == "Root", F.col("total")).otherwise(0)).cast("long").alias("r"))
    g = cells.groupBy("observation_id").agg(F.sum("t").cast("long").alias("tokens"), F.sum("r").cast("long").alias("root_tokens"), F.min_by(F.struct("model", "effort"), F.struct((-F.col("t")).alias("t"), "model", "effort")).alias("top"))
    n = hits.groupBy("observation_id").agg(F.count_distinct("session_id").alias("sessions"))
    marks = range_join(compactions.select("us"), spans, [], "us", "start_us", "end_us", HOUR_US, closed="right", levels=levels).groupBy("observation_id").agg(F.count(F.lit(1)).alias("compactions"))
    out = intervals.join(g, "observation_id", "left").join(n, "observation_id", "left").join(marks, "observation_id", "left").fillna(0, ["tokens", "root_tokens", "sessions", "compactions"])
    minutes = (F.col("end_us") - F.col("start_us")) / 60e6
    confidence = 0.67 + F.when(minutes <= 30, 0.13).when(minutes <= 90, 0.07).otherwise(0.0) + F.when(F.col("tokens") > 0, 0.1).otherwise(0.0)
    return out.withColumns({"subagent_tokens": F.col("tokens") - F.col("root_tokens"), "model": F.col("top.model"), "effort": F.col("top.effort"), "confidence": F.least(F.lit(0.95), confidence)}).drop("top")


def burn_contributors(hits: DataFrame, key: str, most: int) -> DataFrame:
    """sessions' shares of an interval, scored by token, uncached, cache and compaction shares; the top ones."""
    g = hits.groupBy(key, "session_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("total", "uncached", "cache_read", "compactions")))
    w = Window.partitionBy(key)
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)), F.lit(0.0))
    score = 0.55 * share("total") + 0.25 * share("uncached") + 0.15 * share("cache_read") + 0.05 * share("compactions")
    s = g.withColumn("score", score).withColumn("share", share("total"))
    return s.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "session_id"))).where(F.col("_r") <= most).drop("_r")


def effective_samples(values: Column) -> Column:
    """How many independent values a chain of block means is worth; lags up to a third of them, at most ten."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.transform(values, lambda x: x - mean)
    variance = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
    lags = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(n / 3).cast("int"))))
    cov = F.transform(lags, lambda k: F.aggregate(F.zip_with(F.slice(dev, k + 1, F.greatest(n - k, F.lit(0))), F.slice(dev, 1, F.greatest(n - k, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / variance)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(True).alias("on"))
    total = F.aggregate(cov, start, lambda a, x: F.struct((a["s"] + F.when(a["on"] & (x > 0), x).otherwise(0.0)).alias("s"), (a["on"] & (x > 0)).alias("on")))["s"]
    return F.when(n < 2, n.cast("double")).when(variance < 1e-12, 1.0).when(n < 3, n.cast("double")).otherwise(F.least(n.cast("double"), F.greatest(F.lit(1.0), n / (1 + 2 * total))))


def evidence_support(rows: DataFrame, keys: list[str], residual: str, hours: float = 6) -> DataFrame:
    """Raw and non-overlapping rows, blocks, days, span and effective sample size of each key."""
    b = chronological_blocks(rows, keys, hours=hours)
    raw = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"))
    used = b.where("block_id is not null")
    blocks = used.groupBy(*keys, "block_id").agg(F.avg(residual).alias("m"))
    means = blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "m"))), lambda x: x["m"]).alias("means"))
    g = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("independent"), F.count_distinct("block_id").alias("blocks"), F.count_distinct(F.floor(F.col("start_us") / 86_400_000_000)).alias("days"), (F.max("end_us") - F.min("start_us")).alias("span_us"))
    return raw.join(g, keys, "left").join(means, keys, "left").withColumn("effective", effective_samples(F.col("means"))).drop("means")


def pace_estimates(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Rates (percent an hour) at every reading by several models; keys name a series within one epoch."""
    in_order = reading_order(epochs)
    w, at = Window.partitionBy(*keys).orderBy(*in_order), Window.partitionBy(*keys).orderBy("us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = (F.col("us") - F.lag("us").over(w)) / HOUR_US
    e = epochs.withColumns({"_h": gap, "_up": F.greatest(F.lit(0.0), F.col("used") - F.lag("used").over(w)), "_t": (F.col("us") - F.min("us").over(Window.partitionBy(*keys))) / HOUR_US})
    out = e
    for hours in (2, 6):
        # the factor exp(-now/tau) is common to both sums and cancels
        exposure = F.when(F.col("_h") > 0, hours * (1 - F.exp(-F.col("_h") / hours)) * F.exp(F.col("_t") / hours))
        num, den = F.sum(F.col("_up") / F.nullif(F.col("_h"), F.lit(0.0)) * exposure).over(upto), F.sum(exposure).over(upto)
        out = out.withColumn(f"time_ewma_{hours}h", F.coalesce(F.when(den > 0, num / den), F.lit(0.0)))
    first_us, first_used = F.first("us").over(upto), F.first("used").over(upto)
    for name, hours in (("recent_30m", 0.5), ("recent_2h", 2), ("recent_6h", 6), ("recent_24h", 24), ("epoch", None)):
        if hours is None:
            base_us, base = first_us, first_used
        else:
            old = at.rangeBetween(Window.unboundedPreceding, -int(hours * HOUR_US))
            base_us, base = F.coalesce(F.max("us").over(old), first_us), F.coalesce(F.max_by("used", F.struct(*in_order)).over(old), first_used)
        elapsed = (F.col("us") - base_us) / HOUR_US
        out = out.withColumn(name, F.coalesce(F.when(elapsed > 0, F.greatest(F.lit(0.0), F.col("used") - base) / elapsed), F.lit(0.0)))
    return out.withColumns({"persistence": F.lit(0.0), "damped_2h": F.col("recent_2h"), "damped_6h": F.col("recent_2h")}).drop("_h", "_up", "_t")


PACE_MODELS = ("persistence", "time_ewma_2h", "time_ewma_6h", "epoch", "recent_30m", "recent_2h", "recent_6h", "recent_24h", "damped_2h", "damped_6h")


def project_remaining(used: Column, rate: Column, lead_hours: Column, damping: float | None = None) -> Column:
    """What is left after the lead at a rate, which a damped model lets fade."""
    hours = damping * (1 - F.exp(-lead_hours / damping)) if damping else lead_hours
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - used - rate * hours))


def exhaustion_hours(used: Column, rate: Column, damping: float | None = None) -> Column:
    """The inverse, NULL if never reached."""
    plain = (100.0 - used) / F.nullif(rate, F.lit(0.0))
    return plain if damping is None else F.when(plain < damping, -damping * F.log(1 - plain / damping))


def pace_receipt(epochs: DataFrame, keys: list[str], lookback_hours: float) -> DataFrame:
    """Which readings a recent-rate estimate rests on."""
    w = Window.partitionBy(*keys).orderBy(*reading_order(epochs))
    old, upto = Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -int(lookback_hours * HOUR_US)), w.rowsBetween(Window.unboundedPreceding, 0)
    e = epochs.withColumn("_n", F.row_number().over(w))
    base = F.coalesce(F.max("_n").over(old), F.lit(1))
    late, unknown = F.sum((F.coalesce(F.col("collected_us") > F.col("us"), F.lit(False))).cast("int")), F.sum(F.col("collected_us").isNull().cast("int"))
    e = e.withColumns({"_late": late.over(upto), "_unknown": unknown.over(upto), "_base": base, "from_us": F.coalesce(F.max("us").over(old), F.min("us").over(upto))})
    at = lambda c: F.coalesce(F.max(F.col(c)).over(old), F.lit(0))
    return e.select(*keys, "us", "from_us", (F.col("_n") - F.col("_base") + 1).alias("rows"), (F.col("_n") - F.col("_base")).alias("intervals"), F.col("_late").alias("late_so_far"), (F.col("_late") - at("_late")).alias("late_in_window"))


def turn_overlap(turns: DataFrame, origins: DataFrame, lookback_us: int) -> DataFrame:
    """Per origin open and completed turns, their wall hours in the window and the most at once; ends go before
    starts at equal times."""
    window = origins.select(F.col("origin_us"), (F.col("origin_us") - lookback_us).alias("from_us"))
    live = turns.withColumn("_to", F.greatest(F.coalesce("ended_us", "last_us"), "started_us"))
    w = lookback_us
    t = live.withColumn("_b", F.explode(F.sequence(F.floor(F.col("started_us") / w), F.floor(F.col("_to") / w) + 1)))
    o = window.withColumn("_b", F.floor(F.col("origin_us") / w))
    j = o.join(t, "_b").where((F.col("started_us") <= F.col("origin_us")) & (F.col("_to") > F.col("from_us"))).drop("_b").distinct()
    done = F.col("ended_us").isNotNull() & (F.col("ended_us") <= F.col("origin_us"))
    j = j.withColumns({"a": F.greatest("started_us", "from_us"), "b": F.when(done, F.col("ended_us")).otherwise(F.col("origin_us")), "done": done})
    g = j.groupBy("origin_us").agg(F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("open"), F.coalesce(F.sum(F.when(F.col("done"), (F.col("b") - F.col("a")) / HOUR_US)), F.lit(0.0)).alias("wall_hours"))
    edges = j.where("b > a").selectExpr("origin_us", "stack(2, a, 1, b, -1) AS (at, delta)")
    run = F.sum("delta").over(Window.partitionBy("origin_us").orderBy("at", "delta").rowsBetween(Window.unboundedPreceding, 0))
    peak = edges.withColumn("n", run).groupBy("origin_us").agg(F.max("n").alias("peak"))
    return window.select("origin_us").join(g, "origin_us", "left").join(peak, "origin_us", "left").fillna(0)


def latest_turn(turns: DataFrame, key: str, order: str, most: int | None = 150) -> DataFrame:
    """The last turn of each thread, most recent threads first."""
    last = turns.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return last if most is None else last.orderBy(F.desc(order), key).limit(most)


#: How long a thread that is not at work stays in the list.
LISTED_US = 24 * HOUR_US


def recent_threads(turns: DataFrame, items: DataFrame, key: str, as_of_us: Column, recent_us: int, most: int | None = 150) -> DataFrame:
    """Each thread's last turn with the last item of a turn in progress, its state, and the latest time of both; threads at work, and those
    observed in the last 24 hours, the ones at work first, then by that time.

    turns: key, turn, status, started_us, ended_us; items: key, turn, us, item.  `most` is the length of the list."""
    last = latest_turn(turns, key, "turn", None).withColumn("_open", F.col("status") == "in_progress")
    ends = items.groupBy(key, "turn").agg(F.max_by(F.struct("item", F.col("us").alias("item_us")), F.struct("us", "item")).alias("_i"))
    t = last.join(ends, [key, "turn"], "left").withColumns({"last_item": F.when(F.col("_open"), F.col("_i.item")), "_item_us": F.when(F.col("_open"), F.col("_i.item_us"))})
    t = t.withColumn("observed_us", F.greatest(F.coalesce("ended_us", "started_us"), "_item_us"))
    t = t.withColumn("state", activity_state(F.col("status"), F.col("observed_us"), as_of_us, recent_us))
    place = F.when(F.col("state") == "RecentlyWorking", 0).when(F.col("state") == "StaleInProgress", 1).otherwise(2)
    listed = t.where((place < 2) | (F.col("observed_us") >= as_of_us - LISTED_US)).withColumn("_place", place)
    out = listed if most is None else listed.orderBy("_place", F.col("observed_us").desc_nulls_last(), key).limit(most)
    return out.select(key, "turn", "status", "started_us", "state", "observed_us", "last_item")


def evidence_drift(observations: DataFrame, key: str, order: str, fields: list[str], epsilon: float = 1e-12) -> DataFrame:
    """Fields that changed between consecutive observations of a stream, by kind of change."""
    stack = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in fields)
    rows = observations.selectExpr(key, order, f"stack({len(fields)}, {stack}) AS (field, value)")
    w = Window.partitionBy(key, "field").orderBy(order)
    rows = rows.withColumns({"before": F.lag("value").over(w), "_n": F.row_number().over(w)}).where("_n > 1")
    kind = F.when(F.col("value").isNull() != F.col("before").isNull(), "Missingness").when(F.abs(F.col("value") - F.col("before")) > epsilon, "Numerical")
    return rows.withColumn("change", kind).where("change is not null").drop("_n")


def revision_count(captures: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """How often consecutive captures of a period differ."""
    now = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    c = captures.withColumn("_j", now).withColumn("_p", F.lag(now).over(Window.partitionBy(*key).orderBy(order)))
    return c.groupBy(*key).agg(F.count_if(F.col("_p").isNotNull() & (F.col("_j") != F.col("_p"))).alias("revisions"))


def status_changes(snapshots: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """Which fields differ from the row before, one row each."""
    w = Window.partitionBy(*key).orderBy(order)
    diffs = F.array(*(F.when((F.row_number().over(w) > 1) & ~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields))
    return snapshots.withColumn("_d", diffs).select(*key, order, F.explode(F.filter("_d", lambda x: x.isNotNull())).alias("changed"))


def persistent_shifts(blocks: DataFrame, keys: list[str], order: str, value: str, frozen: int = 3) -> DataFrame:
    """Two blocks running beyond max(2, 3 MAD) of the first blocks' median, to the same side."""
    w = Window.partitionBy(*keys).orderBy(order)
    b = blocks.withColumn("_n", F.row_number().over(w))
    ref = b.where(F.col("_n") <= frozen).groupBy(*keys).agg(F.collect_list(value).alias("_v"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == frozen)
    center = median(F.col("_v"))
    ref = ref.withColumn("center", center).withColumn("limit", F.greatest(F.lit(2.0), 3 * median(F.transform("_v", lambda x: F.abs(x - F.col("center"))))))
    side = F.when(F.col(value) - F.col("center") > F.col("limit"), 1).when(F.col("center") - F.col(value) > F.col("limit"), -1).otherwise(0)
    j = b.where(F.col("_n") > frozen).join(ref.select(*keys, "center", "limit"), keys).withColumn("side", side)
    return j.withColumn("shifted", (F.col("side") != 0) & (F.lag("side").over(w) == F.col("side"))).drop("_n")


def change_point(trials: DataFrame, keys: list[str], order: str, error: str, least: int = 8, most: int = 24, control: str | None = None) -> DataFrame:
    """The boundary whose two sides' medians explain the errors best: at least `least` rows each side, at most `most`
    looked at, a shift beyond max(2, 3 MAD) and a quarter less absolute error.  control: a column with the errors of the same
    trials without what is studied; a boundary at which they do not shift the same way does not count."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(-most, -1), w.rowsBetween(0, most - 1)
    t = trials.withColumns({"_l": F.collect_list(error).over(before), "_r": F.collect_list(error).over(after)})
    if control is not None:
        t = t.withColumn("_control", median(F.collect_list(control).over(after)) - median(F.collect_list(control).over(before)))
    t = t.where((F.size("_l") >= least) & (F.size("_r") >= least))
    cost = lambda a, m: F.aggregate(F.transform(a, lambda x: F.abs(x - m)), F.lit(0.0), lambda s, x: s + x)
    t = t.withColumns({"left_median": median(F.col("_l")), "right_median": median(F.col("_r")), "_m": median(F.concat("_l", "_r"))})
    t = t.withColumns({"whole": cost(F.concat("_l", "_r"), F.col("_m")), "split": cost(F.col("_l"), F.col("left_median")) + cost(F.col("_r"), F.col("right_median")), "_mad": median(F.transform("_l", lambda x: F.abs(x - F.col("left_median"))))})
    t = t.withColumn("shift", F.col("right_median") - F.col("left_median"))
    agrees = F.lit(True)
    if control is not None:
        agrees = F.coalesce(F.signum("_control") == F.signum("shift"), F.lit(False))
    ok = agrees & (F.abs("shift") > F.greatest(F.lit(2.0), 3 * F.col("_mad"))) & (F.col("whole") - F.col("split") >= 0.25 * F.col("whole"))
    t = t.where(ok).withColumn("gain", F.col("whole") - F.col("split"))
    return t.groupBy(*keys).agg(F.max_by(F.struct(F.col(order).alias("at"), "shift", "gain"), F.struct("gain", (-F.col(order)).alias("o"))).alias("b")).select(*keys, F.col("b.at").alias("boundary"), F.col("b.shift").alias("shift"), F.col("b.gain").alias("gain"))


def recency_group(age_us: Column) -> Column:
    """How long ago the last activity was, in five groups; NULL age is the last."""
    minutes = age_us / 60_000_000
    return F.when(minutes < 5, "0-5m").when(minutes < 10, "5-10m").when(minutes < 30, "10-30m").when(minutes < 120, "30-120m").otherwise("older")


def latest_snapshot(snapshots: DataFrame, items: DataFrame, host: str, ident: str, order: str) -> DataFrame:
    """The newest snapshot of each host with its items."""
    last = snapshots.withColumn("_r", F.row_number().over(Window.partitionBy(host).orderBy(F.desc(order), F.desc(ident)))).where("_r = 1").drop("_r")
    return last.join(items, ident, "left")
