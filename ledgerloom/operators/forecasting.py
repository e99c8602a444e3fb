"""Features, trials, forecasts and their evaluation (M operators), as jobs over a trials table.

A trial is a row (keys, model, origin_us, outcome_us, resets_us, predicted, observed, ...).  All fits reduce rows
to sums of products by Spark aggregation; only the small solve per group runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import CATEGORIES, complete_categories, half_width, measurement_envelope, median, rank_quantile, valid_percent
from ..sources.shared import kept
from .filters import latest_per_key
from .joins import range_join
from .sequence import HOUR_US, chronological_blocks, independent_rows, reading_order, spaced_origins
from .sliding import active_at, latest_before, merged, pieces_of
from .windows import PACE_MODELS, exhaustion_hours, pace_estimates, project_remaining, recency_group, turn_overlap

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Options:
    """What an evaluation may vary."""

    block_hours: float = 6.0
    least_groups: int = 8
    coverage: float = 0.8
    margin: float = 0.10
    margin_points: float = 0.1
    bands_from: int = 20
    selection_rows: int = 6
    scenario_rows: int = 12
    outcomes: int = 16


# --- features


def origin_features(tokens: DataFrame, turns: DataFrame | None, context: DataFrame, origins: DataFrame, lookback_us: int, edges: DataFrame, mode: str = "reconstructed") -> DataFrame:
    """M1: what happened in (origin - lookback, origin], per origin; `collected` counts only what was known by then.  Without turns their features are left out."""
    from .aggregates import with_role

    e = pieces_of(with_role(tokens, edges), lookback_us, known=F.col("captured_us") if mode == "collected" else None)
    zero = F.lit(0).cast("long")
    sums = {"tokens": F.greatest("total", F.lit(0)), "_cache": F.col("cache_read"), "_in": F.col("uncached") + F.col("cache_read") + F.col("cache_write"), "_reason": F.col("reasoning"), "_out": F.col("output") + F.col("reasoning"), "events": F.lit(1)}
    work = e.select("_s", "_e", *(F.coalesce(v.cast("long"), zero).alias(n) for n, v in sums.items()))
    sessions = merged(e.where(F.col("session_id").isNotNull()).select("role", "session_id", "_s", "_e"), ["role", "session_id"])
    counts = {"roots": F.col("role") == "Root", "subagents": F.col("role") == "Subagent"}
    sessions = sessions.select("_s", "_e", *(v.cast("long").alias(n) for n, v in counts.items()))
    marks = pieces_of(context.where("compaction"), lookback_us).select("_s", "_e", F.lit(1).cast("long").alias("compactions"))
    names = [*sums, *counts, "compactions"]
    full = lambda df: df.select("_s", "_e", *(F.col(n) if n in df.columns else zero.alias(n) for n in names))
    out = active_at(full(work).unionByName(full(sessions)).unionByName(full(marks)), origins, lookback_us, [], names)
    ratio = latest_before(context, origins, lookback_us, F.col("input") / F.col("window"), ["us", "event_id"]).withColumnRenamed("value", "window_ratio")
    out = origins.select("origin_us").join(out, "origin_us", "left").join(ratio, "origin_us", "left")
    if turns is not None:
        out = out.join(turn_overlap(turns, origins, lookback_us), "origin_us", "left").fillna(0, ["completed", "open", "peak"])
    out = out.withColumns({"cache_share": F.when(F.col("_in") > 0, F.col("_cache") / F.col("_in")), "reasoning_share": F.when(F.col("_out") > 0, F.col("_reason") / F.col("_out"))}).drop("_in", "_out", "_cache", "_reason")
    return out.fillna(0, ["tokens", "roots", "subagents", "events", "compactions"])


def recent_pattern(features: DataFrame, shares: DataFrame) -> DataFrame:
    """The current session counts, and the model if there was only one; else why there is no pattern."""
    one = shares.groupBy("origin_us").agg(F.count(F.lit(1)).alias("_n"), F.min("model").alias("only_model"))
    j = features.join(one, "origin_us", "left")
    why = F.when(F.col("events") == 0, "no-recent-tokens").when(F.col("_n") > 1, "mixed-models")
    return j.select("origin_us", "roots", "subagents", F.when(F.col("_n") == 1, F.col("only_model")).alias("model"), why.alias("reason"))


# --- meter trials


def replay_trials(epochs: DataFrame, keys: list[str], horizon_hours: float, models: tuple[str, ...] = PACE_MODELS) -> DataFrame:
    """M2: origins at least half an hour (or the horizon) apart, after a quarter hour of history; each model's
    prediction, the first reading in time after the horizon, and whether the allowance ran out (NULL: unknown)."""
    series = [*keys, "epoch_id"]
    h = int(horizon_hours * HOUR_US)
    in_order = reading_order(epochs)
    w, whole = Window.partitionBy(*series).orderBy(*in_order), Window.partitionBy(*series)
    ahead = Window.partitionBy(*series).orderBy("us").rangeBetween(h, h + 5 * MINUTE_US)
    rest = w.rowsBetween(1, Window.unboundedFollowing)
    e = pace_estimates(epochs.where("epoch_id is not null"), series)
    e = e.withColumns({
        "outcome_us": F.min("us").over(ahead), "_outcome": F.min_by("used", F.struct(*in_order)).over(ahead), "_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(whole),
        "_first": F.min("us").over(whole), "_last": F.max("us").over(whole), "exhausted_us": F.min(F.when(F.col("used") >= 100, F.col("us"))).over(rest),
    })
    ok = (F.col("_all") >= 3) & (F.col("_n") > 1) & (F.col("_n") < F.col("_all")) & (F.col("used") < 100) & (F.col("us") - F.col("_first") >= 15 * MINUTE_US) & (F.col("us") + h <= F.col("resets_us")) & F.col("outcome_us").isNotNull()
    e = spaced_origins(e.where(ok), series, int(min(0.5, horizon_hours) * HOUR_US))
    lead, to_reset = (F.col("outcome_us") - F.col("us")) / HOUR_US, (F.col("resets_us") - F.col("us")) / HOUR_US
    exhausted = F.when(F.col("exhausted_us").isNotNull(), True).when(F.col("_last") == F.col("resets_us"), False)
    def damp(m: str) -> float | None:
        return float(m[7]) if m.startswith("damped") else None

    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("rate"), project_remaining(F.col("used"), F.col(m), lead, damp(m)).alias("predicted"), (project_remaining(F.col("used"), F.col(m), to_reset, damp(m)) <= 0).alias("predicts_exhaustion"), exhaustion_hours(F.col("used"), F.col(m), damp(m)).alias("eta_hours")) for m in models))
    t = e.select(*series, F.col("us").alias("origin_us"), "outcome_us", "resets_us", lead.alias("lead_hours"), F.col("used").alias("origin_used"), (100.0 - F.col("_outcome")).alias("observed"), exhausted.alias("exhausted"), "exhausted_us", F.explode(each).alias("m"))
    error = F.abs(F.col("m.predicted") - F.col("observed"))
    eta_error = F.when(F.col("m.predicts_exhaustion") & F.col("exhausted_us").isNotNull(), F.abs((F.col("exhausted_us") - F.col("origin_us")) / HOUR_US - F.col("m.eta_hours")))
    return t.select(*series, F.col("m.model").alias("model"), "origin_us", "outcome_us", "resets_us", "lead_hours", "origin_used", F.col("m.rate").alias("rate"), F.col("m.predicted").alias("predicted"), "observed", error.alias("error"), "exhausted", F.col("m.predicts_exhaustion").alias("predicts_exhaustion"), eta_error.alias("eta_error"))


def error_radius(errors: Column, options: Options = Options()) -> Column:
    """M4: the rank quantile of (n + 1), at least one point; NULL with too few groups."""
    n = F.size(errors)
    rank = F.least(n, F.ceil((n + 1) * options.coverage).cast("int"))
    return F.when(n >= options.least_groups, F.greatest(F.lit(1.0), F.element_at(F.sort_array(errors), F.greatest(F.lit(1), rank))))


def matured_sums(trials: DataFrame, keys: list[str], sums: dict[str, Column], start: str = "origin_us", end: str = "outcome_us") -> DataFrame:
    """trials with running sums over the rows of their key that ended by the row's start; one window, no join."""
    row = F.struct(*(F.col(c) for c in trials.columns))
    none = F.lit(None).cast(trials.select(row.alias("r")).schema["r"].dataType)
    ends = trials.select(*keys, F.col(end).alias("_t"), F.lit(0).alias("_q"), none.alias("_row"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_v_{n}") for n, c in sums.items()))
    starts = trials.select(*keys, F.col(start).alias("_t"), F.lit(1).alias("_q"), row.alias("_row"), *(F.lit(0.0).alias(f"_v_{n}") for n in sums))
    w = Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    seen = ends.unionByName(starts).select("_q", "_row", *(F.sum(f"_v_{n}").over(w).alias(n) for n in sums)).where("_q = 1")
    return seen.select(*(F.col(f"_row.{c}").alias(c) for c in trials.columns), *sums)


def block_maxima_before(trials: DataFrame, keys: list[str], error: str, options: Options = Options(), most: int = 40, start: str = "origin_us", end: str = "outcome_us", strict: bool = True) -> DataFrame:
    """trials with `calibration`: the greatest errors of the last `most` chronological blocks, of rows that ended before the
    row's start (strict) or by it.  Blocks are built once; a row takes the list of the last block that had begun by then,
    in which the unfinished block counts as far as it has come."""
    b = chronological_blocks(trials, keys, start, end, "resets_us", options.block_hours).where("block_id is not null")
    within = Window.partitionBy(*keys, "block_id").orderBy(end)
    rows = b.select(*keys, "block_id", F.col(end).alias("_t"), F.max(error).over(within).alias("_so_far"))
    blocks = b.groupBy(*keys, "block_id").agg(F.max(error).alias("_m"))
    blocks = blocks.select(*keys, "block_id", F.collect_list("_m").over(Window.partitionBy(*keys).orderBy("block_id").rowsBetween(1 - most, -1)).alias("_past"))
    state = rows.join(blocks, [*keys, "block_id"]).select(*keys, "_t", F.lit(1 if strict else 0).alias("_q"), F.concat("_past", F.array("_so_far")).alias("_list"))
    row = F.struct(*(F.col(c) for c in trials.columns))
    none = F.lit(None).cast(trials.select(row.alias("r")).schema["r"].dataType)
    asked = trials.select(*keys, F.col(start).alias("_t"), F.lit(0 if strict else 1).alias("_q"), F.lit(None).cast("array<double>").alias("_list"), row.alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = state.withColumn("_row", none).unionByName(asked).select("_row", F.last("_list", True).over(w).alias("_list")).where("_row is not null")
    return both.select(*(F.col(f"_row.{c}").alias(c) for c in trials.columns), F.coalesce("_list", F.array().cast("array<double>")).alias("calibration"))


def with_band(trials: DataFrame, options: Options = Options(), low: float = 0.0, high: float | None = 100.0) -> DataFrame:
    r = error_radius(F.col("calibration"), options)
    upper = F.col("predicted") + r
    return trials.withColumns({"radius": r, "lower": F.greatest(F.lit(low), F.col("predicted") - r), "upper": upper if high is None else F.least(F.lit(high), upper)})


def calibration_errors(trials: DataFrame, keys: list[str], options: Options = Options(), most: int = 40) -> DataFrame:
    """M3: trials of one horizon with the block maxima of earlier matured errors, and their radius.

    The outcomes of one horizon follow it within a fifth of it, so all leads are comparable (between half and twice);
    `reset_calibration_errors` is for targets whose leads differ.
    """
    return with_band(block_maxima_before(trials, keys, "error", options, most), options)


def reset_calibration_errors(trials: DataFrame, keys: list[str], options: Options = Options(), most: int = 40, jitter_us: int = 1_000_000) -> DataFrame:
    """M3 for reset targets: one error for each completed reset, of the trial with the most similar lead (between half and
    twice; of equally similar ones the last), the last `most` resets.

    Trials are joined by the bucket of their lead, of which a comparable lead can only lie in the same or a neighbouring one.
    """
    bucket = F.floor(F.log2(F.greatest("lead_hours", F.lit(1e-6)))).cast("int")
    generation = F.floor((F.col("resets_us") + 30 * MINUTE_US) / (60 * MINUTE_US))
    past = trials.select(*keys, bucket.alias("_b"), generation.alias("_g"), F.col("resets_us").alias("_r"), F.col("lead_hours").alias("_l"), F.col("error").alias("_e"), F.col("origin_us").alias("_o"))
    asked = trials.select(*keys, "origin_us", "lead_hours", generation.alias("_mine"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    j = asked.join(past, [*keys, "_b"]).where((F.col("_r") < F.col("origin_us") - jitter_us) & (F.col("_g") != F.col("_mine")) & F.col("_l").between(F.col("lead_hours") / 2, F.col("lead_hours") * 2))
    best = j.groupBy(*keys, "origin_us", "lead_hours", "_g").agg(F.max("_r").alias("_r"), F.min_by("_e", F.struct(F.abs(F.col("_l") - F.col("lead_hours")).alias("d"), (-F.col("_o")).alias("o"))).alias("_e"))
    last = latest_per_key(best, [*keys, "origin_us", "lead_hours"], [F.desc("_r")], most)
    lists = last.groupBy(*keys, "origin_us", "lead_hours").agg(F.collect_list("_e").alias("calibration"))
    out = trials.join(lists, [*keys, "origin_us", "lead_hours"], "left").withColumn("calibration", F.coalesce("calibration", F.array().cast("array<double>")))
    return with_band(out, options)


def select_model(trials: DataFrame, keys: list[str], fallback: str = "time_ewma_2h", preference: tuple[str, ...] = PACE_MODELS, options: Options = Options()) -> DataFrame:
    """M5: the model of least mean error, unless the fallback is practically as good; ties by preference."""
    order = F.array_position(F.array(*map(F.lit, preference)), F.col("model"))
    s = trials.groupBy(*keys, "model").agg(F.round(F.avg("error"), 9).alias("mae"), F.count(F.lit(1)).alias("trials"))
    g = s.groupBy(*keys).agg(F.min_by(F.struct("model", "mae"), F.struct("mae", order.alias("o"))).alias("best"), F.max(F.when(F.col("model") == fallback, F.col("mae"))).alias("fallback_mae"), F.max("trials").alias("trials"))
    keep = (F.col("fallback_mae") <= F.col("best.mae") * (1 + options.margin) + options.margin_points) | (F.col("trials") < options.least_groups)
    return g.select(*keys, F.when(keep, fallback).otherwise(F.col("best.model")).alias("selected"), F.col("best.model").alias("best"), F.col("best.mae").alias("best_mae"), "fallback_mae", "trials")


def reset_outlook(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """M6: state of each stream at its last reading: Learning, Idle, Safe, Near or Exhaust, with rate and margin."""
    e = pace_estimates(epochs.where("epoch_id is not null"), [*keys, "epoch_id"])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "epoch_id"))
    last = latest_per_key(e.withColumn("_n", n).withColumn("_first", F.min("us").over(Window.partitionBy(*keys, "epoch_id"))), keys, [F.desc("us"), F.desc("observation_id")], 1)
    hours, left, rate = (F.col("resets_us") - F.col("us")) / HOUR_US, 100.0 - F.col("used"), F.col("time_ewma_2h")
    margin = left - rate * hours
    state = F.when((F.col("_n") < 3) | (F.col("us") - F.col("_first") < 15 * MINUTE_US), "Learning").when(F.col("used") >= 100, "Exhaust").when(rate <= 0, "Idle").when(margin <= 0, "Exhaust").when(margin < 10, "Near").otherwise("Safe")
    sustainable = F.when(hours > 0, left / hours)
    return last.select(*keys, "us", "used", "resets_us", rate.alias("rate"), sustainable.alias("sustainable"), (rate / F.nullif(sustainable, F.lit(0.0))).alias("pressure"), margin.alias("margin"), F.when((rate > 0) & (margin <= 0), left / rate).alias("eta_hours"), state.alias("state"))


def horizon_predictions(epochs: DataFrame, keys: list[str], horizons: tuple[float, ...] = (0.5, 2.0, 24.0), most: int = 48, features: DataFrame | None = None, names: tuple[str, ...] = ("tokens", "roots"), options: Options = Options()) -> DataFrame:
    """M7: a prediction for each horizon at each stream's latest reading.

    The pace model is the best on the last `most` independent matured trials, if it beats the fallback by 10 % and 0.05
    points.  A workload correction (features: origin_us and `names`) replaces it if it beats both by as much on its own
    last trials.  The band is the rank quantile of at least `bands_from` such errors of what was chosen.
    """
    fallback = "time_ewma_2h"
    epochs, features = kept(epochs, "epochs"), None if features is None else kept(features, "features")
    now = latest_per_key(pace_estimates(epochs.where("epoch_id is not null"), [*keys, "epoch_id"]), keys, [F.desc("us"), F.desc("observation_id")], 1)
    fits = lambda h: (F.col("us") + int(h * HOUR_US) <= F.col("resets_us")) & (F.col("used") < 100)
    beats = lambda a, b: F.coalesce(F.col(a) + 0.05 < F.col(b) * (1 - options.margin), F.lit(False))
    out = []
    for h in horizons:
        trials = kept(replay_trials(epochs, keys, h), "trials")
        recent = latest_per_key(independent_rows(trials, [*keys, "model"], "origin_us", "outcome_us"), [*keys, "model"], [F.desc("origin_us")], most)
        order = F.array_position(F.array(*map(F.lit, PACE_MODELS)), F.col("model"))
        s = recent.groupBy(*keys, "model").agg(F.avg("error").alias("mae"), F.count(F.lit(1)).alias("n"), F.collect_list("error").alias("errors"))
        g = s.groupBy(*keys).agg(F.min_by(F.struct("model", "mae", "errors"), F.struct("mae", order.alias("o"))).alias("_best"), F.max_by(F.struct("model", "mae", "errors"), (F.col("model") == fallback).cast("int")).alias("_usual"), F.max("n").alias("trials"))
        g = g.withColumn("_chosen", F.when((F.col("trials") >= options.selection_rows) & (F.col("_best.mae") + 0.05 < F.col("_usual.mae") * (1 - options.margin)), F.col("_best")).otherwise(F.col("_usual")))
        row = now.where(fits(h)).join(g, keys, "left").withColumn("selected", F.coalesce("_chosen.model", F.lit(fallback)))
        value = lambda name: F.coalesce(*(F.when(F.col(name) == m, project_remaining(F.col("used"), F.col(m), F.lit(h), float(m[7]) if m.startswith("damped") else None)) for m in PACE_MODELS))  # noqa: E731, B023
        row = row.withColumns({"predicted": value("selected"), "_errors": F.col("_chosen.errors"), "workload_trials": F.lit(0).cast("long")})
        if features is not None:
            work = workload_correction(trials.where(F.col("model") == fallback).join(features, "origin_us"), keys, list(names), 10.0).where("training is not null")
            work = latest_per_key(independent_rows(work, keys, "origin_us", "outcome_us"), keys, [F.desc("origin_us")], most)
            w = work.groupBy(*keys).agg(F.avg("corrected_error").alias("_w"), F.avg("error").alias("_wb"), F.count(F.lit(1)).alias("_wn"), F.collect_list("corrected_error").alias("_we"))
            last = trials.where(F.col("model") == fallback).select(*keys, "origin_us", "outcome_us", "predicted", "observed").join(features, "origin_us")
            live = now.select(*keys, F.col("us").alias("origin_us"), F.lit(None).cast("long").alias("outcome_us"), project_remaining(F.col("used"), F.col(fallback), F.lit(h)).alias("predicted"), F.lit(None).cast("double").alias("observed")).join(features, "origin_us")
            fit = workload_correction(last.unionByName(live), keys, list(names), 10.0).where("outcome_us is null and training is not null").select(*keys, F.col("corrected").alias("_live"))
            row = row.join(w, keys, "left").join(fit, keys, "left").withColumns({"_p": F.col("_chosen.mae"), "workload_trials": F.coalesce("_wn", F.lit(0).cast("long"))})
            use = F.col("_live").isNotNull() & (F.col("workload_trials") >= options.selection_rows) & beats("_w", "_wb") & beats("_w", "_p")
            row = row.withColumn("_use", use).withColumns({"selected": F.when(F.col("_use"), "workload").otherwise(F.col("selected")), "predicted": F.when(F.col("_use"), F.least(F.col("_live"), 100.0 - F.col("used"))).otherwise(F.col("predicted")), "_errors": F.when(F.col("_use"), F.col("_we")).otherwise(F.col("_errors"))})
        n = F.size("_errors")
        rank = F.least(n, F.ceil((n + 1) * options.coverage).cast("int"))
        radius = F.when(n >= options.bands_from, F.greatest(F.lit(1.0), F.element_at(F.sort_array("_errors"), F.greatest(F.lit(1), rank))))
        out.append(row.select(*keys, F.lit(h).alias("horizon"), F.col("us").alias("origin_us"), "selected", "predicted", radius.alias("radius"), F.coalesce("trials", F.lit(0)).alias("trials"), "workload_trials"))
    return reduce(DataFrame.unionByName, out)


def forecast_scores(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Errors, coverage, exhaustion accuracy and how many trials do not overlap."""
    free = independent_rows(trials, [*keys, "epoch_id"], "origin_us", "outcome_us").groupBy(*keys).agg(F.count(F.lit(1)).alias("independent"))
    has = F.col("radius").isNotNull() if "radius" in trials.columns else F.lit(False)
    inside = (F.abs(F.col("predicted") - F.col("observed")) <= F.col("radius")) if "radius" in trials.columns else F.lit(False)
    g = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.when(has, inside.cast("double"))).alias("coverage"),
        F.avg(F.when(F.col("exhausted").isNotNull(), (F.col("exhausted") == F.col("predicts_exhaustion")).cast("double"))).alias("exhaustion_accuracy"), F.avg("eta_error").alias("eta_error"),
    )
    return g.join(free, keys, "left").fillna(0, ["independent"])


def pace_validation(trials: DataFrame) -> DataFrame:
    """Errors by model, state of use and lead to reset, with subtotals."""
    t = trials.withColumns({"use": F.when(F.col("rate") > 0, "active").otherwise("flat"), "reset_lead": F.when((F.col("resets_us") - F.col("origin_us")) / HOUR_US < 24, "under-24h").otherwise("later")})
    t.createOrReplaceTempView("_pace_validation")
    return trials.sparkSession.sql("SELECT model, use, reset_lead, count(*) AS trials, avg(error) AS mae FROM _pace_validation GROUP BY GROUPING SETS ((model), (model, use), (model, reset_lead))")


def rank_allowances(forecasts: DataFrame, account: str, ties: tuple[str, ...] = ("us", "account")) -> DataFrame:
    """Each owner's windows by which limits first: exhausted, then soonest to run out, then pressure, then reset, then by `ties`."""
    order = [F.desc(F.col("used") >= 100), F.asc_nulls_last("eta_hours"), F.desc_nulls_last("pressure"), F.asc_nulls_last("resets_us"), *(F.col(c) for c in ties if c in forecasts.columns)]
    top = F.row_number().over(Window.partitionBy(account).orderBy(*order))
    status = F.when(F.col("used") >= 100, "Exhausted").when(F.col("eta_hours").isNotNull(), "RunsOut").otherwise("Lasts")
    return forecasts.withColumn("rank", top).withColumn("status", status)


def current_forecasts(lanes: DataFrame, now_us: int, stale_us: int = 15 * MINUTE_US, epochs: DataFrame | None = None, keys: list[str] | None = None, horizons: tuple[float, ...] = (0.5, 2.0, 24.0), features: DataFrame | None = None) -> DataFrame:
    """Each lane's forecasts now: its reset outlook (M6) and horizons (M7), or why there are none.

    Without epochs only the gate is applied.
    """
    from ..functions.scalars import authority

    gate = F.when(F.col("us") > now_us, "future").when(now_us - F.col("us") > stale_us, "stale").when(authority(F.col("source")) != "ProviderAuthoritative", "not-authoritative").when(F.col("account").isNull(), "account-unknown").when(~valid_percent(F.col("used")), "invalid")
    gated = lanes.withColumn("withheld", gate)
    if epochs is None:
        return gated
    open_ = gated.where("withheld is null").select(*keys).distinct()
    mine = epochs.where(F.col("us") <= now_us).join(open_, keys, "left_semi")
    outlook = reset_outlook(mine, keys).select(*keys, "state", "rate", "margin", "pressure", "eta_hours")
    ahead = horizon_predictions(mine, keys, horizons, features=features)
    points = ahead.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("horizon", "selected", "predicted", "radius", "trials"))).alias("points"))
    out = gated.join(outlook, keys, "left").join(points, keys, "left")
    return out.withColumn("withheld", F.coalesce("withheld", F.when(F.col("state").isNull(), "no-epoch")))


# --- fits


def _products(features: list[str], target: str) -> list[Column]:
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    out = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y")]
    out += [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)] + [F.sum(a * y).alias(f"t{i}") for i, a in enumerate(x)]
    return out + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]


def solve_ridge(r, d: int, penalty: float) -> tuple[float, list[float]] | None:
    """Intercept and coefficients of standardised ridge from sums; None if singular."""
    n = r["n"]
    if not n or n < 2:
        return None
    m = np.array([r[f"s{i}"] for i in range(d)]) / n
    my = r["y"] / n
    cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] / n - m[i] * m[j] for j in range(d)] for i in range(d)])
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1.0
    a = cov / np.outer(scale, scale) + np.eye(d) * penalty / n
    b = np.array([r[f"t{i}"] / n - m[i] * my for i in range(d)]) / scale
    try:
        w = np.linalg.solve(a, b) / scale
    except np.linalg.LinAlgError:
        return None
    return (float(my - w @ m), w.tolist()) if np.isfinite(w).all() else None


def _solved(stats: DataFrame, keep: list[str], d: int, penalty: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [solve_ridge(r, d, penalty) for r in b.to_dict("records")]
            yield b[keep].assign(intercept=[f[0] if f else None for f in fits], weights=[f[1] if f else None for f in fits])

    ddl = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)
    return stats.mapInPandas(run, f"{ddl}, intercept double, weights array<double>")


def ridge_fit(df: DataFrame, features: list[str], target: str, penalty: float, by: list[str]) -> DataFrame:
    """M8: one standardised ridge fit per group, from sums alone; NULL weights if singular."""
    return _solved(df.groupBy(*by).agg(*_products(features, target)), [*by, "n"], len(features), penalty)


def ridge_apply(features: list[str], name: str = "") -> Column:
    return F.aggregate(F.zip_with(F.array(*(F.col(f).cast("double") for f in features)), F.col(f"{name}weights"), lambda x, w: x * w), F.col(f"{name}intercept"), lambda a, v: a + v)


def ridges_before(trials: DataFrame, keys: list[str], fits: dict[str, tuple[list[str], str]], penalty: float = 1.0, last: int = 120, least: int = 12) -> DataFrame:
    """For every trial ridges on the `last` trials that matured by its origin, by differences of running sums; fits: name -> (features, target).

    All fits share one pass over the trials.  Adds {name}intercept, {name}weights and the number of training rows.
    """
    terms, names = {"n": F.lit(1.0)}, {}
    for name, (features, target) in fits.items():
        x, y = [F.col(f).cast("double") for f in features], F.col(target).cast("double")
        own = {"y": y} | {f"s{i}": a for i, a in enumerate(x)} | {f"t{i}": a * y for i, a in enumerate(x)} | {f"p{i}_{j}": x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))}
        names[name] = list(own)
        terms |= {f"{name}{n}": t for n, t in own.items()}
    matured = trials.where("outcome_us is not null")
    w = Window.partitionBy(*keys).orderBy("outcome_us", "origin_us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = matured.select(*keys, F.row_number().over(w).alias("_c"), *(F.sum(t).over(upto).alias(f"_{n}") for n, t in terms.items()))
    marks = matured.select(*keys, F.col("outcome_us").alias("_t"), F.lit(0).alias("_q"), F.lit(None).cast("long").alias("origin_us")).unionByName(trials.select(*keys, F.col("origin_us").alias("_t"), F.lit(1).alias("_q"), "origin_us"))
    seen = marks.withColumn("_c", F.sum(1 - F.col("_q")).over(Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0))).where("_q = 1").select(*keys, "origin_us", "_c").distinct()
    old = sums.select(*keys, (F.col("_c") + last).alias("_c"), *(F.col(f"_{n}").alias(f"o_{n}") for n in terms))
    j = seen.join(sums, [*keys, "_c"]).join(old, [*keys, "_c"], "left")
    stats = j.select(*keys, "origin_us", *((F.col(f"_{n}") - F.coalesce(f"o_{n}", F.lit(0.0))).alias(n) for n in terms)).where(F.col("n") >= least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, rows = b[[*keys, "origin_us", "n"]], b.to_dict("records")
            for name, (features, _) in fits.items():
                solved = [solve_ridge({"n": r["n"]} | {n: r[name + n] for n in names[name]}, len(features), penalty) for r in rows]
                out = out.assign(**{f"{name}intercept": [f[0] if f else None for f in solved], f"{name}weights": [f[1] if f else None for f in solved]})
            yield out

    ddl = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in [*keys, "origin_us", "n"]) + "".join(f", {n}intercept double, {n}weights array<double>" for n in fits)
    return trials.join(stats.mapInPandas(run, ddl).withColumnRenamed("n", "training"), [*keys, "origin_us"], "left")


def ridge_before(trials: DataFrame, keys: list[str], features: list[str], target: str, penalty: float = 1.0, last: int = 120, least: int = 12) -> DataFrame:
    """M9's fits: intercept, weights and training for every trial."""
    return ridges_before(trials, keys, {"": (features, target)}, penalty, last, least)


def workload_correction(trials: DataFrame, keys: list[str], features: list[str], penalty: float = 1.0, seen: str | None = None) -> DataFrame:
    """M9: pace predictions corrected by a ridge on their earlier residuals; without a fit they stay as they are.

    seen: an array column of the models and efforts at work.  A trial with one that no earlier matured trial of its key had
    keeps the pace prediction, as such work is not the training rows' average.
    """
    t = trials.withColumn("_residual", F.col("observed") - F.col("predicted"))
    fit = ridge_before(t, keys, features, "_residual", penalty)
    if seen is not None:
        first = t.where("outcome_us is not null").select(*keys, F.explode(seen).alias("_s"), "outcome_us").groupBy(*keys, "_s").agg(F.min("outcome_us").alias("_since"))
        each = t.select(*keys, "origin_us", F.explode(seen).alias("_s")).distinct().join(first, [*keys, "_s"], "left")
        unseen = each.groupBy(*keys, "origin_us").agg(F.bool_or(F.coalesce(F.col("_since") > F.col("origin_us"), F.lit(True))).alias("unseen"))
        fit = fit.join(unseen, [*keys, "origin_us"], "left").withColumn("unseen", F.coalesce("unseen", F.lit(True)))
        fit = fit.withColumns({c: F.when(~F.col("unseen"), F.col(c)) for c in ("weights", "intercept", "training")})
    shift = F.coalesce(ridge_apply(features), F.lit(0.0))
    value = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("predicted") + shift))
    return fit.withColumns({"corrected": value, "corrected_error": F.abs(value - F.col("observed"))}).drop("_residual", "weights", "intercept")


def backtest_candidates(trials: DataFrame, keys: list[str], candidates: dict[str, list[str]]) -> DataFrame:
    """Mean errors of pace and of its corrections by several feature sets."""
    trials = kept(trials, "trials")
    base = trials.groupBy(*keys).agg(F.lit("pace").alias("candidate"), F.count(F.lit(1)).alias("trials"), F.avg("error").alias("mae"))
    rows = [workload_correction(trials, keys, f).groupBy(*keys).agg(F.lit(n).alias("candidate"), F.count(F.lit(1)).alias("trials"), F.avg("corrected_error").alias("mae")) for n, f in candidates.items()]
    return reduce(DataFrame.unionByName, rows, base)


# --- token forecasts


def token_trials(tokens: DataFrame, keys: list[str], horizon_us: int, step_us: int = 5 * MINUTE_US) -> DataFrame:
    """Origins on the horizon's grid with at least one token in the two hours before; the tokens that came next,
    and the estimates from the last half hour, two hours and eight matured targets."""
    bins = tokens.where("total >= 0").groupBy(*keys, (F.ceil(F.col("us") / step_us) * step_us).alias("at")).agg(F.sum("total").cast("long").alias("t"))
    ends = bins.groupBy(*keys).agg(F.min("at").alias("_a"), F.max("at").alias("_z"))
    grid = ends.select(*keys, F.explode(F.filter(F.sequence((F.floor((F.col("_a") + 2 * HOUR_US) / horizon_us) + 1) * horizon_us, F.greatest(F.col("_z"), (F.floor((F.col("_a") + 2 * HOUR_US) / horizon_us) + 1) * horizon_us), F.lit(horizon_us)), lambda x: x + horizon_us <= F.col("_z"))).alias("at"))
    both = bins.withColumn("_g", F.lit(False)).unionByName(grid.withColumn("t", F.lit(0).cast("long")).withColumn("_g", F.lit(True)))
    w = Window.partitionBy(*keys).orderBy("at")
    total = lambda a, b: F.coalesce(F.sum("t").over(w.rangeBetween(a, b)), F.lit(0)).cast("long")
    rows = both.withColumns({"target": total(1, horizon_us), "_half": total(1 - 30 * MINUTE_US, 0), "_two": total(1 - 2 * HOUR_US, 0)}).where("_g").where("_two > 0")
    rows = rows.select(*keys, F.col("at").alias("origin_us"), (F.col("at") + horizon_us).alias("outcome_us"), "target", (F.col("_half") * horizon_us / (30.0 * MINUTE_US)).alias("recent_30m"), (F.col("_two") * horizon_us / (2.0 * HOUR_US)).alias("recent_2h"))
    before = Window.partitionBy(*keys).orderBy("origin_us").rowsBetween(-8, -1)
    return rows.withColumn("median_8", F.coalesce(median(F.collect_list(F.col("target").cast("double")).over(before)), F.col("recent_30m")))


CANDIDATES = ("recent_30m", "recent_2h", "median_8", "linear_ridge", "log_ridge")


def token_forecast(tokens: DataFrame, keys: list[str], horizon_us: int, least: int = 16, gain: float = 0.2, bands: int = 20) -> DataFrame:
    """All candidates per origin, the one chosen on earlier comparisons, and a band from its earlier errors."""
    t = token_trials(tokens, keys, horizon_us).withColumns({"_lt": F.log1p("target"), "_l30": F.log1p("recent_30m"), "_l2": F.log1p("recent_2h")})
    plain, logs = ["recent_30m", "recent_2h"], ["_l30", "_l2"]
    t = ridges_before(t, keys, {"lin_": (plain, "target"), "log_": (logs, "_lt")})
    t = t.withColumns({
        "linear_ridge": F.greatest(F.lit(0.0), F.coalesce(ridge_apply(plain, "lin_"), F.col("recent_30m"))),
        "log_ridge": F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("log_weights").isNotNull(), F.expm1(F.least(F.lit(60.0), ridge_apply(logs, "log_")))), F.col("recent_30m"))),
    }).drop("lin_intercept", "lin_weights", "log_intercept", "log_weights", "training", "_lt", "_l30", "_l2")
    past = Window.partitionBy(*keys).orderBy("origin_us").rowsBetween(-48, -1)
    errors = {c: F.avg(F.abs(F.col(c) - F.col("target"))).over(past) for c in CANDIDATES}
    t = t.withColumns({f"_e_{c}": e for c, e in errors.items()}).withColumn("_n", F.count(F.lit(1)).over(past))
    best = F.array_min(F.array(*(F.struct(F.col(f"_e_{c}").alias("e"), F.lit(i).alias("i"), F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(CANDIDATES))))
    t = t.withColumn("_b", best)
    wins = (F.col("_n") >= least) & (F.col("_b.e") <= (1 - gain) * F.col("_e_recent_30m"))
    t = t.withColumns({"selected": F.when(wins, F.col("_b.c")).otherwise("recent_30m"), "prediction": F.when(wins, F.col("_b.v")).otherwise(F.col("recent_30m"))})
    miss = F.collect_list(F.abs(F.col("prediction") - F.col("target"))).over(past)
    t = t.withColumn("_m", miss).withColumn("radius", F.when(F.size("_m") >= bands, rank_quantile(F.col("_m"), 0.8)))
    return t.drop("_m", "_b", "_n", *(f"_e_{c}" for c in CANDIDATES))


def token_forecast_scores(forecasts: DataFrame, keys: list[str], candidates=(*CANDIDATES, "prediction")) -> DataFrame:
    """Errors and coverage by candidate."""
    long = forecasts.select(*keys, "target", "radius", *(F.col(c).cast("double").alias(c) for c in candidates)).unpivot([*keys, "target", "radius"], list(candidates), "candidate", "value")
    e = F.abs(F.col("value") - F.col("target"))
    return long.groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("trials"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when((F.col("candidate") == "prediction") & F.col("radius").isNotNull(), (e <= F.col("radius")).cast("double"))).alias("coverage"))


def nowcast_gate(tokens: DataFrame, turns: DataFrame, at_us: int, keys: list[str], recent_us: int = 10 * MINUTE_US) -> DataFrame:
    """Whether there is activity to extrapolate at a time."""
    last = tokens.where((F.col("us") <= at_us) & (F.col("total") > 0)).groupBy(*keys).agg(F.max("us").alias("last_us"))
    live = turns.where(F.col("started_us") <= at_us).groupBy(*keys).agg(F.count_if(F.col("ended_us").isNull() | (F.col("ended_us") > at_us)).alias("open"))
    state = F.when(F.col("last_us").isNull(), "Unknown").when(at_us - F.col("last_us") < recent_us, "RecentActivity").when(F.col("open") > 0, "QuietOpenTurn").otherwise("NoRecent")
    return last.join(live, keys, "full").fillna(0, ["open"]).withColumn("gate", state)


def activity_hurdle(tokens: DataFrame, keys: list[str], horizon_us: int, least: int = 20, most: int = 120) -> DataFrame:
    """Probability of any tokens next by how recent the last ones were, Beta(1, 1) on earlier origins of the same
    group (or of all, while the group is small), and the mean and range of what came when it was active."""
    t = token_trials(tokens, keys, horizon_us)
    seen = tokens.where("total > 0").select(*keys, F.col("us").alias("at")).withColumn("_g", F.lit(0)).unionByName(t.select(*keys, F.col("origin_us").alias("at")).withColumn("_g", F.lit(1)))
    last = F.max(F.when(F.col("_g") == 0, F.col("at"))).over(Window.partitionBy(*keys).orderBy("at", "_g").rowsBetween(Window.unboundedPreceding, 0))
    age = seen.withColumn("_l", last).where("_g = 1").select(*keys, F.col("at").alias("origin_us"), (F.col("at") - F.col("_l")).alias("age_us")).distinct()
    t = t.join(age, [*keys, "origin_us"]).withColumn("recency", recency_group(F.col("age_us"))).withColumn("active", (F.col("target") > 0).cast("int"))
    group = Window.partitionBy(*keys, "recency").orderBy("origin_us").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*keys).orderBy("origin_us").rowsBetween(-most, -1)
    rate = lambda w: (F.coalesce(F.sum("active").over(w), F.lit(0)) + 1) / (F.count(F.lit(1)).over(w) + 2)
    small = F.count(F.lit(1)).over(group) < least
    amounts = F.collect_list(F.when(F.col("target") > 0, F.col("target").cast("double"))).over(all_)
    t = t.withColumns({"probability": F.when(small, rate(all_)).otherwise(rate(group)), "baseline": rate(all_), "_a": amounts})
    mean = F.when(F.size("_a") > 0, F.aggregate("_a", F.lit(0.0), lambda a, x: a + x) / F.size("_a"))
    return t.withColumns({"conditional_mean": mean, "low": rank_quantile(F.col("_a"), 0.1, False), "high": rank_quantile(F.col("_a"), 0.9, False)}).drop("_a")


def probability_scores(trials: DataFrame, keys: list[str], probability: str = "probability", outcome: str = "active", bins: int = 5) -> DataFrame:
    """Brier score, that of the base rate, and calibration error over equal bins."""
    t = trials.withColumn("_bin", F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)))
    b = t.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum(probability).alias("p"), F.sum(outcome).alias("o"), F.sum(F.pow(F.col(probability) - F.col(outcome), 2)).alias("s"))
    g = b.groupBy(*keys).agg(F.sum("n").cast("long").alias("trials"), (F.sum("s") / F.sum("n")).alias("brier"), (F.sum("o") / F.sum("n")).alias("base_rate"), (F.sum(F.abs(F.col("p") - F.col("o"))) / F.sum("n")).alias("calibration_error"))
    return g.withColumn("baseline_brier", F.col("base_rate") * (1 - F.col("base_rate")))


def usual_activity_study(hurdles: DataFrame, keys: list[str], split: float = 0.8) -> DataFrame:
    """Candidates on the first four fifths and the last fifth of the range: MAE, WAPE and signed sum."""
    ends = hurdles.groupBy(*keys).agg(F.min("origin_us").alias("_a"), F.max("origin_us").alias("_z"))
    t = hurdles.join(ends, keys).withColumn("part", F.when(F.col("origin_us") < F.col("_a") + (F.col("_z") - F.col("_a")) * split, "development").otherwise("final"))
    t = t.withColumns({"hurdle": F.col("probability") * F.coalesce("conditional_mean", F.lit(0.0)), "global_hurdle": F.col("baseline") * F.coalesce("conditional_mean", F.lit(0.0)), "zero": F.lit(0.0)})
    names = ["hurdle", "global_hurdle", "zero", "recent_30m", "recent_2h", "median_8"]
    long = t.select(*keys, "part", "target", *(F.col(n).cast("double").alias(n) for n in names)).unpivot([*keys, "part", "target"], names, "candidate", "value")
    e = F.col("value") - F.col("target")
    return long.groupBy(*keys, "part", "candidate").agg(F.count(F.lit(1)).alias("trials"), F.avg(F.abs(e)).alias("mae"), (F.sum(F.abs(e)) / F.nullif(F.sum("target"), F.lit(0))).alias("wape"), F.sum(e).alias("signed"))


# --- workload continuation


def joint_before(tokens: DataFrame, origins: DataFrame, context_us: int) -> DataFrame:
    """(origin_us, model, effort) cells of the context before each origin."""
    e = pieces_of(tokens, context_us).select("model", "effort", "_s", "_e", F.lit(1).cast("long").alias("_n"), *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in CATEGORIES), *(F.col(c).isNotNull().cast("long").alias(f"_k_{c}") for c in CATEGORIES))
    cells = active_at(e, origins, context_us, ["model", "effort"], ["_n", *CATEGORIES, *(f"_k_{c}" for c in CATEGORIES)]).where("_n > 0")
    return cells.select("origin_us", "model", "effort", *(F.when(F.col(f"_k_{c}") > 0, F.col(c)).cast("decimal(38,0)").alias(c) for c in CATEGORIES))


def continue_workload(tokens: DataFrame, origins: DataFrame, context_us: int, horizon_us: int) -> DataFrame:
    """The joint mix of the context carried on for the horizon, with nine decimals."""
    cells = joint_before(tokens, origins, context_us)
    return cells.select("origin_us", "model", "effort", *(F.bround((F.col(c) * F.lit(horizon_us).cast("decimal(20,0)") / F.lit(context_us).cast("decimal(20,0)")), 9).cast("decimal(38,9)").alias(c) for c in CATEGORIES))


def project_composition(tokens: DataFrame, predictions: DataFrame, context_us: int = 2 * HOUR_US) -> DataFrame:
    """A predicted total spread over the last two hours' mix.  predictions: origin_us, predicted."""
    cells = joint_before(tokens, predictions, context_us)
    long = cells.unpivot(["origin_us", "model", "effort"], list(CATEGORIES), "category", "tokens")
    share = F.col("tokens").cast("double") / F.nullif(F.sum(F.col("tokens").cast("double")).over(Window.partitionBy("origin_us")), F.lit(0.0))
    return long.withColumn("share", share).join(predictions.select("origin_us", "predicted"), "origin_us").withColumn("amount", F.col("share") * F.col("predicted")).drop("tokens")


def continuation_scores(tokens: DataFrame, origins: DataFrame, horizon_us: int, contexts: dict[str, int]) -> DataFrame:
    """Contexts of several lengths on the same targets: error of the total, and distance of the mixes."""
    actual = joint_before(tokens, origins.select((F.col("origin_us") + horizon_us).alias("origin_us")), horizon_us).withColumn("origin_us", F.col("origin_us") - horizon_us)
    total = lambda df, n: df.select("origin_us", "model", "effort", sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])).cast("double").alias(n))
    a = total(actual, "a")
    out = []
    for name, us in contexts.items():
        p = total(continue_workload(tokens, origins, us, horizon_us), "p")
        j = p.join(a, ["origin_us", "model", "effort"], "full").fillna(0.0, ["a", "p"])
        w = Window.partitionBy("origin_us")
        j = j.withColumns({"_a": F.sum("a").over(w), "_p": F.sum("p").over(w)}).where("_a > 0 and _p > 0")
        g = j.groupBy("origin_us").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum(F.abs(F.col("a") / F.col("_a") - F.col("p") / F.col("_p"))).alias("l1"))
        e = F.col("p") - F.col("a")
        out.append(g.agg(F.lit(name).alias("context"), F.count(F.lit(1)).alias("targets"), F.avg(F.abs(e)).alias("mae"), (F.sum(F.abs(e)) / F.sum("a")).alias("wape"), F.sum(e).alias("signed"), F.avg("l1").alias("share_distance")))
    return reduce(DataFrame.unionByName, out)


def work_plan(continued: DataFrame, relabel: dict[str, str], prices: DataFrame, weights: DataFrame | None = None, reference: float = 1e6) -> DataFrame:
    """Continued work after an edit of model labels, valued anew.  prices: model, category, price; weights: category, weight, by which the
    edited work is scored as well, per `reference` weighted tokens."""
    swap = F.coalesce(*(F.when(F.col("model") == a, F.lit(b)) for a, b in relabel.items()), F.col("model"))
    cells = continued.withColumn("model", swap).groupBy("origin_us", "model", "effort").agg(*(F.sum(c).alias(c) for c in CATEGORIES))
    long = cells.unpivot(["origin_us", "model", "effort"], list(CATEGORIES), "category", "tokens").join(prices, ["model", "category"], "left")
    sums = [F.sum("tokens").cast("decimal(38,9)").alias("tokens"), F.sum((F.col("tokens") * F.col("price")).cast("decimal(38,9)")).alias("value"), F.sum(F.when(F.col("price").isNull(), F.col("tokens")).otherwise(0)).cast("decimal(38,9)").alias("unpriced")]
    if weights is not None:
        long = long.join(weights, "category", "left")
        sums.append((F.sum(F.col("tokens").cast("double") * F.col("weight")) / reference).alias("score"))
    return long.groupBy("origin_us").agg(*sums)


# --- cost of work in meter points


def cost_candidates(epochs: DataFrame, keys: list[str], horizon_hours: float) -> DataFrame:
    """Every reading as an interval's start, with its end and the first reason against it (overlap comes later)."""
    series = [*keys, "epoch_id"]
    h = int(horizon_hours * HOUR_US)
    tolerance = int(min(5.0, horizon_hours * 12) * MINUTE_US)
    in_order = reading_order(epochs)
    w, whole = Window.partitionBy(*series).orderBy(*in_order), Window.partitionBy(*series)
    ahead = Window.partitionBy(*series).orderBy("us").rangeBetween(h, Window.unboundedFollowing)
    e = epochs.where("epoch_id is not null").withColumns({"end_us": F.min("us").over(ahead), "end_used": F.min_by("used", F.struct(*in_order)).over(ahead), "_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(whole), "_first": F.min("us").over(whole)})
    e = e.where((F.col("_n") > 1) & (F.col("_n") < F.col("_all")))
    reason = (
        F.when(F.col("used") >= 100, "saturated-origin").when(F.col("us") - F.col("_first") < 15 * MINUTE_US, "epoch-warmup").when(F.col("end_us").isNull(), "no-outcome-in-epoch")
        .when(F.col("end_us") - F.col("us") - h > tolerance, "outcome-beyond-poll-tolerance").when(F.col("end_used") >= 100, "saturated-outcome")
    )
    return e.select(*series, F.col("us").alias("start_us"), "end_us", F.col("used").alias("start_used"), "end_used", "resets_us", "source", reason.alias("reason"))


def cost_observations(candidates: DataFrame, keys: list[str], events: DataFrame) -> DataFrame:
    """The sound intervals that do not overlap, with their envelope, token categories and flags."""
    from ..functions.scalars import authority

    series = [*keys, "epoch_id"]
    good = independent_rows(candidates.where("reason is null"), series)
    lower, upper = measurement_envelope(F.col("start_used"), F.col("end_used"), authority(F.col("source")) == "ProviderAuthoritative")
    good = kept(good.withColumns({"lower": lower, "upper": upper, "id": F.xxhash64(*series, "start_us")}), "cost-intervals")
    hits = range_join(events, good.select("id", "start_us", "end_us"), [], "us", "start_us", "end_us", HOUR_US, closed="right")
    g = hits.groupBy("id").agg(*(F.sum(F.greatest(c, F.lit(0))).cast("double").alias(c) for c in CATEGORIES), F.count(F.lit(1)).alias("events"), F.count_if(~complete_categories()).alias("_partial"), F.count_if(F.col("model").isNull() | F.col("effort").isNull()).alias("_unlabelled"), F.count_if(F.col("captured_us").isNull() | (F.col("captured_us") > F.col("end_us"))).alias("_late"))
    j = good.join(g, "id", "left").fillna(0, [*CATEGORIES, "events", "_partial", "_unlabelled", "_late"])
    from .joins import reasons

    flags = reasons(no_recorded_tokens=F.col("events") == 0, incomplete_token_categories=F.col("_partial") > 0, missing_model_or_effort=F.col("_unlabelled") > 0, backfilled_or_unknown_collection_time=F.col("_late") > 0)
    return j.withColumn("flags", flags).drop("_partial", "_unlabelled", "_late")


def nonnegative_ridge(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, penalty: float = 0.1, prior: np.ndarray | None = None, steps: int = 2000) -> np.ndarray:
    """Weights >= 0 without intercept that come closest to the envelopes; RMS-scaled, by projected gradient."""
    return nonnegative_ridges(x[None], lower[None], upper[None], penalty, None if prior is None else prior[None], steps)[0]


def nonnegative_ridges(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, penalty: float = 0.1, prior: np.ndarray | None = None, steps: int = 2000) -> np.ndarray:
    """`nonnegative_ridge` of many cohorts of equally many rows at once: x by cohort, row and feature; each cohort stops where it has come to rest."""
    scale = np.sqrt((x * x).mean(1))
    scale[scale < 1e-12] = 1.0
    z = x / scale[:, None]
    p = np.zeros(scale.shape) if prior is None else prior * scale
    n, out, live = x.shape[1], np.maximum(p, 0), np.arange(len(x))
    rate = 1.0 / (np.linalg.norm(z, 2, axis=(1, 2)) ** 2 / n + penalty)
    w, rate = out.copy(), rate[:, None]
    for _ in range(steps):
        if not len(live):
            break
        y = (z @ w[:, :, None])[:, :, 0]
        miss = np.where(y < lower, y - lower, np.where(y > upper, y - upper, 0.0))
        new = np.maximum(0, w - rate * ((miss[:, None] @ z)[:, 0] / n + penalty * (w - p)))
        moving = ~(np.abs(new - w).max(1) < 1e-10)
        if not moving.all():
            live, z, lower, upper, p, rate, new = (a[moving] for a in (live, z, lower, upper, p, rate, new))
        w = new
        out[live] = w
    return out / scale


def interval_ridge(observations: DataFrame, keys: list[str], features: list[str], first: int = 20, penalty: float = 0.1) -> DataFrame:
    """One fit per cohort on its first rows, so a group is never larger than `first`; many cohorts are fitted at once."""
    train = latest_per_key(observations, keys, [F.col("start_us"), F.col("end_us")], first)
    row = F.array(*(F.col(c).cast("double") for c in (*features, "lower", "upper")))
    d = len(features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("_rows")).to_numpy()
            rows = batch.column("_rows").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 2)
            ends, weights = np.cumsum(sizes), np.empty((len(sizes), d))
            for n in np.unique(sizes):
                mine = np.flatnonzero(sizes == n)
                of = rows[(ends[mine] - n)[:, None] + np.arange(n)]
                weights[mine] = nonnegative_ridges(of[:, :, :d], of[:, :, d], of[:, :, d + 1], penalty)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(sizes.astype("int64")), pa.array(list(weights), pa.list_(pa.float64()))], [*keys, "n", "weights"])

    groups = train.groupBy(*keys).agg(F.collect_list(row).alias("_rows"))
    return groups.mapInArrow(fit, T.StructType([*(groups.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def cost_vectors(cells: DataFrame, ids: list[str], vocabulary: DataFrame) -> DataFrame:
    """Design rows: total, categories, and a column per known (model, effort); unknown cells are one overflow."""
    j = cells.join(vocabulary.withColumn("_known", F.lit(True)), ["model", "effort"], "left")
    name = F.when(F.col("_known"), F.concat_ws("|", "model", "effort")).otherwise("overflow")
    whole = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])).cast("double")
    g = j.groupBy(*ids, name.alias("_cell")).agg(F.sum(whole).alias("t"), *(F.sum(F.col(c).cast("double")).alias(c) for c in CATEGORIES))
    return g.groupBy(*ids).agg(F.sum("t").alias("total"), *(F.sum(c).alias(c) for c in CATEGORIES), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_cell", "t")))).alias("cells"))


def design_diagnostics(observations: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Gram matrix by aggregation; active columns, rank, participation dimension and greatest cosine per cohort."""
    d = len(features)
    x = [F.col(f).cast("double") for f in features]
    stats = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                g = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
                size = np.sqrt(np.diag(g))
                on = size > 1e-12
                c = g[np.ix_(on, on)] / np.outer(size[on], size[on]) if on.any() else np.zeros((0, 0))
                e = np.linalg.eigvalsh(c) if len(c) else np.zeros(0)
                part = float(e.sum() ** 2 / (e * e).sum()) if len(e) else 0.0
                top = float(np.abs(c - np.eye(len(c))).max()) if len(c) > 1 else 0.0
                rows.append((int(on.sum()), int((e > 1e-9).sum()), part, top))
            yield b[[*keys, "n"]].assign(**dict(zip(("active", "rank", "participation", "max_cosine"), zip(*rows) if rows else ([],) * 4)))

    ddl = ", ".join(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keys)
    return stats.mapInPandas(run, f"{ddl}, n long, active long, rank long, participation double, max_cosine double")


def uncertainty_diagnostics(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Errors, band widths, and how often a band holds the outcome or meets the meter's own tolerance."""
    w = half_width(F.col("observed") == F.floor("observed"))
    t = trials.where("radius is not null")
    return t.groupBy(*keys).agg(
        F.min("error").alias("least_error"), F.max("error").alias("greatest_error"), F.avg(F.col("upper") - F.col("lower")).alias("width"),
        F.avg(F.col("observed").between(F.col("lower"), F.col("upper")).cast("double")).alias("contained"),
        F.avg(((F.col("observed") + w >= F.col("lower")) & (F.col("observed") - w <= F.col("upper"))).cast("double")).alias("intersected"),
    )


def regime_report(trials: DataFrame, keys: list[str], control: str | None = None) -> DataFrame:
    """The change point of each cohort's errors and a one-word marker.  control: a column of errors that must shift the same way."""
    from .windows import change_point

    n = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"))
    j = n.join(change_point(trials, keys, "origin_us", "error", control=control), keys, "left")
    return j.withColumn("marker", F.when(F.col("trials") < 16, "Insufficient").when(F.col("boundary").isNotNull(), "Shift").otherwise("Stable"))


def composed_breakdowns(trials: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Scores by several ways to label a trial, in one pass."""
    labels = F.array(*(F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("label")) for n, c in dims.items()))
    long = trials.select("model", "error", F.explode(labels).alias("l"))
    return long.groupBy("model", F.col("l.dimension").alias("dimension"), F.col("l.label").alias("label")).agg(F.count(F.lit(1)).alias("trials"), F.avg("error").alias("mae"))


def scenario_history(trials: DataFrame, features: DataFrame) -> DataFrame:
    """Meter movement of past intervals with what ran in them.  trials: one model's; features: by outcome as origin."""
    f = features.select(F.col("origin_us").alias("outcome_us"), "roots", "subagents", "tokens")
    moved = (100.0 - F.col("origin_used")) - F.col("observed")
    return trials.join(f, "outcome_us").withColumn("moved", moved)


def scenario_funnel(history: DataFrame, stages: dict[str, Column], keys: list[str]) -> DataFrame:
    """How many rows enter and pass each stage, in order."""
    passed, cols = F.lit(True), []
    for name, test in stages.items():
        entered = passed
        passed = passed & F.coalesce(test, F.lit(False))
        cols.append(F.struct(F.lit(name).alias("stage"), F.count_if(entered).alias("entered"), F.count_if(passed).alias("passed")))
    g = history.groupBy(*keys).agg(F.array(*cols).alias("s"))
    return g.select(*keys, F.posexplode("s").alias("position", "s")).select(*keys, "position", "s.stage", "s.entered", "s.passed")


eligibility_funnel = scenario_funnel


def threshold_study(trials: DataFrame, keys: list[str], configs: dict[str, Options], split: float = 0.8) -> DataFrame:
    """One option varied at a time.  The model is chosen on the first part of the range under each option; the last
    part gives its error and how wide and how good its bands are.  `best` marks the option with the least error in
    the first part (of equal ones the default, then by name)."""
    trials = kept(trials, "trials")
    ends = trials.groupBy(*keys).agg(F.min("origin_us").alias("_a"), F.max("origin_us").alias("_z"))
    t = kept(trials.join(ends, keys).withColumn("_dev", F.col("origin_us") < F.col("_a") + (F.col("_z") - F.col("_a")) * split), "study")
    out = []
    for name, options in configs.items():
        chosen = select_model(t.where("_dev"), keys, options=options).select(*keys, F.col("selected").alias("model"))
        banded = calibration_errors(t.join(chosen, [*keys, "model"]), keys, options)
        inside = F.when(F.col("radius").isNotNull(), (F.abs(F.col("predicted") - F.col("observed")) <= F.col("radius")).cast("double"))
        final = banded.groupBy(*keys, "model").agg(
            F.count_if("_dev").alias("development"), F.avg(F.when(F.col("_dev"), F.col("error"))).alias("development_mae"), F.count_if(~F.col("_dev")).alias("trials"), F.avg(F.when(~F.col("_dev"), F.col("error"))).alias("mae"),
            F.avg(F.when(~F.col("_dev"), inside)).alias("coverage"), F.avg(F.when(~F.col("_dev"), F.col("upper") - F.col("lower"))).alias("width"),
        )
        out.append(final.withColumn("config", F.lit(name)))
    whole = reduce(DataFrame.unionByName, out)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("development_mae"), F.col("config") != "default", "config")
    return whole.withColumn("best", F.row_number().over(w) == 1)


def censoring_study(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals that the meter's ceiling leaves out beside the ordinary ones."""
    c = candidates.withColumn("censored", F.coalesce(F.col("reason").startswith("saturated"), F.lit(False)))
    moved = F.col("end_used") - F.col("start_used")
    return c.where("reason is null or censored").groupBy(*keys, "censored").agg(F.count(F.lit(1)).alias("attempts"), F.percentile_disc("start_used", 0.5).alias("median_start") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY start_used)").alias("median_start"), F.avg(moved).alias("mean_moved"))


# --- path studies


def resample_paths(bins: DataFrame, origins: DataFrame, keys: list[str], paths: int, steps: int, run: int = 3, seed: int = 7) -> DataFrame:
    """Block bootstrap of time bins for each origin: a path is made of runs of `run` neighbouring bins from before the origin, picked by a
    seeded hash; a bin brings its whole mixture.  bins: keys, at and any amounts; origins: keys, origin_us."""
    w = Window.partitionBy(*keys)
    numbered = bins.withColumn("_i", F.row_number().over(w.orderBy("at")) - 1)
    both = bins.select(*keys, F.col("at").alias("_t"), F.lit(0).alias("_q")).unionByName(origins.select(*keys, F.col("origin_us").alias("_t"), F.lit(1).alias("_q")))
    size = both.withColumn("_n", F.sum(1 - F.col("_q")).over(w.orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0))).where("_q = 1 and _n > 0").select(*keys, F.col("_t").alias("origin_us"), "_n").distinct()
    grid = size.select("*", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    start = F.pmod(F.xxhash64(F.lit(seed), *keys, "origin_us", "path", F.floor(F.col("step") / run)), F.greatest(F.lit(1), F.col("_n") - run + 1))
    grid = grid.withColumn("_i", F.least((start + F.col("step") % run), F.col("_n") - 1).cast("int"))
    return grid.drop("_n").join(numbered, [*keys, "_i"]).drop("_i")


def first_crossing(steps: DataFrame, keys: list[str], budget: float, cost: str = "t") -> DataFrame:
    """Share of paths whose running cost reaches the budget, and quantiles of the step at which they do; a path shorter than its fellows that has
    not reached it is unresolved."""
    run = F.sum(cost).over(Window.partitionBy(*keys, "path").orderBy("step"))
    hit = steps.withColumn("_c", run).groupBy(*keys, "path").agg(F.min(F.when(F.col("_c") >= budget, F.col("step"))).alias("hit"), F.max("step").alias("_last"))
    hit = hit.withColumn("_end", F.max("_last").over(Window.partitionBy(*keys)))
    g = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("paths"), F.count("hit").alias("crossed"), F.count_if(F.col("hit").isNull() & (F.col("_last") < F.col("_end"))).alias("unresolved"), F.collect_list("hit").alias("_h"))
    return g.select(*keys, "paths", "crossed", "unresolved", (F.col("crossed") / F.col("paths")).alias("share"), rank_quantile(F.col("_h"), 0.1).alias("early"), rank_quantile(F.col("_h"), 0.5).alias("middle"), rank_quantile(F.col("_h"), 0.9).alias("late"))
