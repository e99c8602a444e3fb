"""Evaluations that freeze a fit on a cohort's first rows and score it on later ones.

Observations are the rows of `cost_observations` (M20): keys, start_us, end_us, resets_us, start_used, end_used, lower,
upper, token categories, events, and, where the caller has them, pace_delta and incumbent_delta: the movement that the pace
and the incumbent forecast expected at the start.  A cohort's training rows are at most `first`, so fits are bounded groups;
everything else is joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import CATEGORIES, interval_loss, valid_percent
from ..sources.shared import kept
from .earlier import bands_before
from .filters import latest_per_key
from .forecasting import MINUTE_US, Options, block_maxima_before, continue_workload, error_radius, interval_ridge, matured_sums, nonnegative_ridge, ridge_apply, ridge_before, with_band
from .joins import range_join, reasons
from .sequence import HOUR_US, SECOND_US, chronological_blocks, independent_rows


def moved() -> Column:
    return F.col("end_used") - F.col("start_used")


def loss_of(predicted: Column) -> Column:
    return interval_loss(predicted, F.col("lower"), F.col("upper"))


def cost_of(features: list[str], weights: str = "weights", prefix: str = "") -> Column:
    """What the frozen weights make of a row's work."""
    x = F.array(*(F.coalesce(F.col(prefix + f).cast("double"), F.lit(0.0)) for f in features))
    return F.aggregate(F.zip_with(x, F.col(weights), lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)


def frozen_parts(observations: DataFrame, keys: list[str], first: int = 20, work: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """observations with `part`: training (the first rows), heldout (those that start after the last of them ended) or
    overlap; and `issue`: why the cohort has no fit."""
    w, whole = Window.partitionBy(*keys).orderBy("start_us", "end_us"), Window.partitionBy(*keys)
    o = observations.withColumn("_n", F.row_number().over(w))
    trains = F.col("_n") <= first
    o = o.withColumns({"_end": F.max(F.when(trains, F.col("end_us"))).over(whole), "_all": F.count(F.lit(1)).over(whole), "_work": F.sum(F.when(trains, sum((F.col(c) for c in work[1:]), F.col(work[0]))).otherwise(0)).over(whole)})
    part = F.when(trains, "training").when(F.col("start_us") >= F.col("_end"), "heldout").otherwise("overlap")
    issue = F.when(F.col("_all") < first, "insufficient-training-intervals").when(F.col("_work") <= 0, "no-recorded-training-work")
    return o.withColumns({"part": part, "issue": issue}).drop("_n", "_end", "_all", "_work")


def block_means(trials: DataFrame, keys: list[str], values: list[str], hours: float = 6.0, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """The means of each chronological block's rows: keys, block_id, ends_us, rows, values."""
    b = chronological_blocks(trials, keys, start, end, "resets_us", hours).where("block_id is not null")
    return b.groupBy(*keys, "block_id").agg(F.max(end).alias("ends_us"), F.count(F.lit(1)).alias("block_rows"), *(F.avg(v).alias(v) for v in values))


# --- M24


def training_policy(observations: DataFrame, keys: list[str], asserted: DataFrame | None = None, first: int = 20, most: int = 120) -> DataFrame:
    """The rows a cohort's fit may use: its first rows, and before them up to `most` earlier rows that the user asserted to
    be the same account's, none overlapping another.  asserted: same keys and columns; it adds nothing to a short cohort."""
    native = latest_per_key(observations, keys, [F.col("start_us"), F.col("end_us")], first).withColumn("role", F.lit("native"))
    if asserted is None:
        return native
    begins = native.groupBy(*keys).agg(F.min("start_us").alias("_from"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= first)
    early = asserted.join(begins, keys).where(F.col("end_us") <= F.col("_from")).drop("_from", "_k")
    chosen = latest_per_key(independent_rows(early, keys), keys, [F.desc("start_us"), F.desc("end_us")], most).withColumn("role", F.lit("asserted"))
    return native.unionByName(chosen)


# --- M22


def cost_trials(observations: DataFrame, keys: list[str], candidates: dict[str, list[str]], first: int = 20) -> DataFrame:
    """The held-out rows of cohorts with a fit, once for each candidate: the frozen fits, `zero`, and `pace` where it is known."""
    observations = kept(observations, "cost-rows")
    parts = frozen_parts(observations, keys, first)
    rows = parts.where("part = 'heldout' and issue is null")
    out = [rows.withColumn("predicted", F.lit(0.0)).withColumn("candidate", F.lit("zero"))]
    if "pace_delta" in observations.columns:
        out.append(rows.withColumn("predicted", F.col("pace_delta")).withColumn("candidate", F.lit("pace")))
    for name, features in candidates.items():
        fit = interval_ridge(observations, keys, features, first).select(*keys, "weights")
        out.append(rows.join(fit, keys).withColumn("predicted", cost_of(features)).drop("weights").withColumn("candidate", F.lit(name)))
    t = reduce(DataFrame.unionByName, out)
    return t.withColumns({"loss": loss_of(F.col("predicted")), "residual": moved() - F.col("predicted")})


def cost_evaluation(observations: DataFrame, keys: list[str], candidates: dict[str, list[str]], first: int = 20, parent: str = "zero", options: Options = Options()) -> DataFrame:
    """Each candidate frozen on the first rows and scored on the later disjoint ones: interval loss by row and by block,
    residual quantiles, bands from the greatest losses of all earlier blocks, and whether it wins materially over `parent`: a block loss
    smaller by a tenth and by 0.1 points, and better in most blocks."""
    by = [*keys, "candidate"]
    t = kept(bands_before(kept(cost_trials(observations, keys, candidates, first), "cost-trials"), by, "loss", options), "cost-bands")
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by residual)")
    banded = F.col("radius").isNotNull()
    g = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("loss").alias("loss"), F.avg(F.abs("residual")).alias("mae"), F.max("loss").alias("worst"), at(0.1).alias("low_residual"), at(0.5).alias("middle_residual"), at(0.9).alias("high_residual"),
        F.count_if(banded).alias("bands"), F.avg(F.when(banded, (F.col("loss") <= F.col("radius")).cast("double"))).alias("covered"),
    )
    blocks = block_means(t, by, ["loss"], options.block_hours)
    theirs = blocks.where(F.col("candidate") == parent).select(*keys, "block_id", F.col("loss").alias("_theirs"))
    b = blocks.join(theirs, [*keys, "block_id"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), F.avg("loss").alias("block_loss"), F.avg("_theirs").alias("parent_loss"), F.count_if(F.col("loss") < F.col("_theirs")).alias("_wins"))
    wins = (F.col("block_loss") <= (1 - options.margin) * F.col("parent_loss")) & (F.col("parent_loss") - F.col("block_loss") >= options.margin_points) & (2 * F.col("_wins") > F.col("blocks"))
    return g.join(b.withColumn("material_win", F.coalesce(wins, F.lit(False))).drop("_wins"), by, "left")


# --- M28, M29


def composed_trials(observations: DataFrame, keys: list[str], features: list[str], tokens: DataFrame, first: int = 20, context_us: int = 2 * HOUR_US) -> DataFrame:
    """M28's targets: the same held-out rows with the frozen cost of the work that was forecast (the last `context_us` carried on),
    of the actual work, the pace's and the incumbent's movement, and why a row is withheld."""
    observations = kept(observations, "cost-rows")
    parts = frozen_parts(observations, keys, first)
    fit = interval_ridge(observations, keys, features, first).select(*keys, "weights")
    rows = parts.where("part = 'heldout'").join(fit, keys, "left")
    prior = continue_workload(tokens, rows.select(F.col("start_us").alias("origin_us")).distinct(), context_us, HOUR_US)
    prior = prior.groupBy("origin_us").agg(*(F.sum(c).cast("double").alias(f"_h_{c}") for c in features)).withColumnRenamed("origin_us", "start_us")
    hours = (F.col("end_us") - F.col("start_us")) / HOUR_US
    j = rows.join(prior, "start_us", "left").withColumns({f"_f_{c}": F.col(f"_h_{c}") * hours for c in features})
    j = j.withColumns({"forecast_delta": F.when(F.col(f"_h_{features[0]}").isNotNull(), cost_of(features, prefix="_f_")), "actual_delta": cost_of(features)})
    withheld = F.coalesce(F.col("issue"), F.when(F.col("forecast_delta").isNull(), "no-recent-work"))
    arms = {"forecast_work": "forecast_delta", "actual_work": "actual_delta", "pace": "pace_delta", "incumbent": "incumbent_delta"}
    return j.withColumn("withheld", withheld).withColumns({f"{a}_loss": F.when(F.col(c).isNotNull(), loss_of(F.col(c))) for a, c in arms.items()}).withColumn("nothing_loss", loss_of(F.lit(0.0))).drop("weights", *(f"_h_{c}" for c in features), *(f"_f_{c}" for c in features))


ARMS = ("forecast_work", "actual_work", "pace", "incumbent", "nothing")


def composed_evaluation(observations: DataFrame, keys: list[str], features: list[str], tokens: DataFrame, first: int = 20, options: Options = Options()) -> DataFrame:
    """Every arm's block-balanced loss on identical targets (those that none of them lacks), and the withheld ones by reason."""
    t = kept(composed_trials(observations, keys, features, tokens, first), "composed")
    why = t.where("withheld is not null").groupBy(*keys, "withheld").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "withheld", F.col("k").cast("string")))), ",").alias("withheld"), F.sum("k").alias("withheld_rows"))
    good = t.where(" and ".join(["withheld is null", *(f"{a}_loss is not null" for a in ARMS)]))
    losses = [f"{a}_loss" for a in ARMS]
    b = block_means(good, keys, losses, options.block_hours).groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), *(F.avg(c).alias(c) for c in losses))
    n = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("targets"))
    out = observations.select(*keys).distinct().join(n, keys, "left").join(b, keys, "left").join(why, keys, "left")
    return out.fillna(0, ["targets", "blocks", "withheld_rows"]).fillna("", ["withheld"])


def assess_selection(trials: DataFrame, keys: list[str], as_of_us: int, strict: bool = False, options: Options = Options(), horizon_hours: float = 1.0) -> DataFrame:
    """Why a challenger may not replace pace and incumbent; no reason means that it may.

    trials: origin_us, outcome_us, resets_us, error, loss, pace_loss, incumbent_loss (NULL: not paired).  Losses are balanced over
    chronological blocks.  strict: the last two blocks must not lose either.  `radius` is the combined uncertainty, from the
    greatest error of each block that was over by as_of_us.
    """
    trials = kept(trials, "assessed")
    n = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.count("incumbent_loss").alias("pairs"), F.max("outcome_us").alias("_last"))
    blocks = block_means(trials, keys, ["loss", "pace_loss", "incumbent_loss"], options.block_hours, "origin_us", "outcome_us")
    recent = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ends_us"))) <= 2
    good = (F.col("loss") <= F.col("incumbent_loss")) & (F.col("loss") <= F.col("pace_loss"))
    b = blocks.withColumn("_recent", recent).groupBy(*keys).agg(
        F.sum("block_rows").alias("independent"), F.count(F.lit(1)).alias("blocks"), F.avg("loss").alias("loss"), F.avg("pace_loss").alias("pace_loss"), F.avg("incumbent_loss").alias("incumbent_loss"),
        F.count_if(F.col("loss") < F.col("incumbent_loss")).alias("_wins"), F.coalesce(F.bool_and(F.when(F.col("_recent"), F.coalesce(good, F.lit(False)))), F.lit(False)).alias("_recent_good"),
    )
    matured = chronological_blocks(trials.where(F.col("outcome_us") <= as_of_us), keys, "origin_us", "outcome_us", "resets_us", options.block_hours).where("block_id is not null")
    worst = matured.groupBy(*keys, "block_id").agg(F.max("error").alias("m")).groupBy(*keys).agg(error_radius(F.collect_list("m"), options).alias("radius"))
    j = n.join(b, keys, "left").join(worst, keys, "left")
    paired = F.col("pairs") == F.col("trials")
    beats = lambda other: (F.col("loss") + options.margin_points < F.col(other)) & (F.col("loss") < F.col(other) * (1 - options.margin))
    late = as_of_us - int(max(2.0, 2 * horizon_hours) * HOUR_US)
    why = reasons(
        too_few_outcomes=F.col("trials") < options.outcomes, too_few_independent=F.coalesce("independent", F.lit(0)) < options.outcomes, too_few_blocks=F.coalesce("blocks", F.lit(0)) < options.least_groups, outcome_after_assessment=F.col("_last") > as_of_us,
        no_recent_outcome=F.col("_last") < late, unpaired=~paired, not_better_than_pace=~beats("pace_loss"), not_better_than_incumbent=paired & ~beats("incumbent_loss"), no_majority_of_blocks=paired & (F.col("_wins") <= F.floor(F.col("blocks") / 2)),
        recent_block_lost=paired & ~F.col("_recent_good") if strict else F.lit(False),
    )
    return j.withColumn("reasons", F.array_join(why, ",")).drop("_last", "_wins", "_recent_good")


# --- M33


def scenario_estimate(history: DataFrame, keys: list[str], request: dict[str, float], options: Options = Options()) -> DataFrame:
    """Meter movement of a planned scenario (lead_hours, roots, subagents) from past intervals, for each stream.

    Every past interval is predicted from those that ended before it, by elapsed time and by a ridge; the ridge is taken if its earlier
    errors are smaller by a tenth and 0.1 points.  The band is the rank quantile of the greatest error of that choice in each
    chronological block of comparable length.  A request outside what was seen has no estimate.
    history: origin_us, outcome_us, resets_us, lead_hours, roots, subagents, moved.
    """
    names = list(request)
    clip = lambda c: F.when(c.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)))
    better = lambda ridge, base: ridge + options.margin_points < base * (1 - options.margin)
    history = kept(history, "scenarios")
    h = matured_sums(history, keys, {"_n": F.lit(1), "_moved": F.col("moved"), "_hours": F.col("lead_hours")})
    h = ridge_before(h, keys, names, "moved", 10.0, 10**9, options.selection_rows)
    h = kept(h, "scenario-fits").withColumns({"_base": F.abs(F.col("moved") - clip(F.col("_moved") / F.nullif(F.col("_hours"), F.lit(0.0)) * F.col("lead_hours"))), "_ridge": F.abs(F.col("moved") - clip(ridge_apply(names)))})
    trials = h.where("_n >= %d and _ridge is not null and _base is not null" % options.selection_rows).drop("weights", "intercept", "training", "_n", "_moved", "_hours")
    t = matured_sums(trials, keys, {"_k": F.lit(1), "_sb": F.col("_base"), "_sr": F.col("_ridge")})
    use = (F.col("_k") >= options.selection_rows) & better(F.col("_sr") / F.col("_k"), F.col("_sb") / F.col("_k"))
    t = kept(t.withColumn("error", F.when(use, F.col("_ridge")).otherwise(F.col("_base"))), "scenario-trials")
    asked = float(request["lead_hours"])
    like = t.where(F.col("lead_hours").between(asked / 2, asked * 2) & F.col("resets_us").isNotNull())
    blocks = chronological_blocks(like, keys, "origin_us", "outcome_us", "resets_us", options.block_hours).where("block_id is not null")
    band = blocks.groupBy(*keys, "block_id").agg(F.max("error").alias("m")).groupBy(*keys).agg(error_radius(F.collect_list("m"), options).alias("radius"))
    chosen = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.avg("_base").alias("baseline_mae"), F.avg("_ridge").alias("ridge_mae"))
    last = history.withColumn("outcome_us", F.coalesce("outcome_us", "origin_us"))
    ask = last.groupBy(*keys).agg((F.max("outcome_us") + 1).alias("origin_us"), F.count(F.lit(1)).alias("rows"), (F.sum("moved") / F.nullif(F.sum("lead_hours"), F.lit(0.0))).alias("pace"), *(F.min(n).alias(f"_min_{n}") for n in names), *(F.max(n).alias(f"_max_{n}") for n in names))
    whole = history.select(*keys, "origin_us", "outcome_us", "moved", *names).unionByName(ask.select(*keys, "origin_us", F.lit(None).cast("long").alias("outcome_us"), F.lit(None).cast("double").alias("moved"), *(F.lit(float(request[n])).alias(n) for n in names)))
    fit = ridge_before(whole, keys, names, "moved", 10.0, 10**9, options.selection_rows).where("outcome_us is null").select(*keys, clip(ridge_apply(names)).alias("_fit"))
    j = ask.join(chosen, keys, "left").join(band, keys, "left").join(fit, keys, "left")
    ridge = F.coalesce((F.col("trials") >= options.selection_rows) & better(F.col("ridge_mae"), F.col("baseline_mae")) & F.col("_fit").isNotNull(), F.lit(False))
    outside = reasons(**{f"{n}_outside_support": (F.lit(float(v)) < F.col(f"_min_{n}")) | (F.lit(float(v)) > F.col(f"_max_{n}")) for n, v in request.items()})
    reason = F.when(F.col("rows") < options.scenario_rows, "too-few-rows").when(F.size(outside) > 0, F.array_join(outside, ","))
    value = F.when(ridge, F.col("_fit")).otherwise(clip(F.col("pace") * asked))
    j = j.withColumns({"reason": reason, "model": F.when(ridge, "ridge").otherwise("elapsed"), "predicted": F.when(reason.isNull(), value)})
    return j.select(*keys, "rows", F.coalesce("trials", F.lit(0)).alias("trials"), "model", "predicted", F.when(F.col("reason").isNull(), F.greatest(F.lit(0.0), F.col("predicted") - F.col("radius"))).alias("lower"), F.when(F.col("reason").isNull(), F.least(F.lit(100.0), F.col("predicted") + F.col("radius"))).alias("upper"), "reason")


# --- M39


def score_issued(points: DataFrame, epochs: DataFrame, keys: list[str], as_of_us: int, collect_us: int = 5 * MINUTE_US) -> DataFrame:
    """Issued forecasts with the state of their outcome; without refitting or retiming.

    points: origin_us, target_us, resets_us, anchor_used, predicted, horizon_hours (NULL: for the reset), confirmed_us.
    epochs: readings with epoch_id, used, resets_us, collected_us, observation_id.  An outcome is the first reading of the
    anchor's epoch in time after the target, within a fifth of the horizon and `collect_us`; for a reset the last one within `collect_us` before it.
    """
    known = epochs.where((F.col("us") <= as_of_us) & F.col("epoch_id").isNotNull() & (F.col("collected_us").isNull() | (F.col("collected_us") <= as_of_us)))
    known = kept(latest_per_key(known, [*keys, "us"], [F.desc("observation_id")], 1), "known")
    timely = (F.col("used") >= 100) & (F.col("collected_us") >= F.col("us")) & (F.col("collected_us") <= F.col("us") + collect_us)
    later = Window.partitionBy(*keys, "epoch_id").orderBy("us").rowsBetween(1, Window.unboundedFollowing)
    known = known.withColumn("_full_us", F.min(F.when(timely, F.col("us"))).over(later))
    p = points.withColumn("_id", F.xxhash64(*keys, "origin_us", "target_us", "horizon_hours"))
    anchor = known.select(*keys, F.col("us").alias("origin_us"), "epoch_id", F.col("used").alias("_used"), F.col("resets_us").alias("_resets"), F.col("_full_us"))
    p = p.join(anchor, [*keys, "origin_us"], "left").withColumn("_lane", F.coalesce("epoch_id", F.lit(-1)))
    tolerance = F.when(F.col("horizon_hours").isNull(), F.lit(collect_us)).otherwise(F.least(F.lit(float(collect_us)), F.col("horizon_hours") * 0.2 * HOUR_US)).cast("long")
    spans = p.select(*keys, "_lane", "_id", "target_us", "origin_us", F.when(F.col("horizon_hours").isNull(), F.col("target_us") - tolerance).otherwise(F.col("target_us")).alias("_from"), (F.col("target_us") + F.when(F.col("horizon_hours").isNull(), F.lit(0)).otherwise(tolerance)).alias("_to"), F.col("horizon_hours").isNull().alias("_reset"))
    read = known.select(*keys, F.col("epoch_id").alias("_lane"), F.col("us").alias("outcome_us"), F.col("used").alias("_seen"), F.col("collected_us").alias("_got"))
    hits = range_join(read, spans, [*keys, "_lane"], "outcome_us", "_from", "_to", HOUR_US, closed="both").where("outcome_us > origin_us")
    one = F.struct("outcome_us", "_seen", "_got")
    first = hits.groupBy("_id").agg(F.when(F.bool_or("_reset"), F.max_by(one, "outcome_us")).otherwise(F.min_by(one, "outcome_us")).alias("o"))
    j = p.join(first, "_id", "left").select(*points.columns, "_used", "_resets", "_full_us", "epoch_id", "o.outcome_us", F.col("o._seen").alias("outcome_used"), "o._got")
    confirmed = F.col("confirmed_us")
    state = (
        F.when(confirmed.isNull(), "unconfirmed").when(confirmed < F.col("origin_us"), "invalid-issue-clock").when(confirmed >= F.col("target_us"), "issued-at-or-after-target").when(confirmed > as_of_us, "confirmation-after-cutoff")
        .when(F.col("predicted").isNull(), "point-unsupported").when(~F.coalesce((F.col("anchor_used") >= 0) & (F.col("anchor_used") < 100), F.lit(False)), "anchor-not-forecastable").when(F.col("target_us") > F.col("resets_us"), "target-crosses-reset")
        .when(F.col("target_us") > as_of_us, "target-immature")
        .when(~F.coalesce((F.col("_used") == F.col("anchor_used")) & (F.abs(F.col("_resets") - F.col("resets_us")) <= SECOND_US), F.lit(False)), "anchor-unavailable-or-revised")
        .when(F.col("outcome_us").isNull() | ~F.coalesce(valid_percent(F.col("outcome_used")), F.lit(False)), "compatible-target-unavailable").when(F.col("_got").isNull(), "outcome-collection-unknown").when(F.col("_got") < F.col("outcome_us"), "invalid-outcome-clock")
        .when(F.col("_got") > F.col("outcome_us") + collect_us, "outcome-collected-too-late").otherwise("matched")
    )
    j = j.withColumn("state", state)
    matched, reset = F.col("state") == "matched", F.col("horizon_hours").isNull()
    full = F.when(F.col("_full_us") <= F.col("target_us"), F.col("_full_us"))
    reached = F.when(reset, F.when(full.isNotNull(), True).when(F.col("outcome_us") == F.col("resets_us"), False)).otherwise(F.when(F.col("outcome_used") < 100, False).when(full.isNotNull(), True))
    j = j.withColumns({"saturated": matched & (F.col("outcome_used") >= 100), "observed": F.when(matched, 100.0 - F.col("outcome_used")), "predicts_full": F.when(matched, F.col("predicted") <= 0), "reaches_full": F.when(matched, reached)})
    return j.withColumns({"error": F.col("predicted") - F.col("observed"), "warning_minutes": F.when(F.col("predicts_full"), (full - confirmed) / MINUTE_US), "before_target": F.coalesce((confirmed < F.col("target_us")) & (confirmed <= as_of_us), F.lit(False))}).drop("_used", "_resets", "_full_us", "_got", "epoch_id")


def issued_scores(scored: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:
    """M39's figures by stream, horizon and lead to the reset: availability, errors of ordinary outcomes (saturated ones are counted apart),
    missed bursts (2 points seen, under 1 predicted), threshold verdicts, warning times, and how often each state stands."""
    hours = (F.col("resets_us") - F.col("origin_us")) / HOUR_US
    t = kept(scored, "issued").withColumn("reset_lead", F.when(hours <= 2, "0-2h").when(hours <= 24, "2-24h").otherwise("over-24h"))
    by = [*keys, "horizon_hours", "reset_lead"]
    ordinary = (F.col("state") == "matched") & ~F.col("saturated")
    e = F.when(ordinary, F.col("error"))
    left = 100.0 - F.col("anchor_used")
    banded = F.col("lower").isNotNull() & F.col("upper").isNotNull() if "lower" in scored.columns else F.lit(False)
    inside = F.col("observed").between(F.col("lower"), F.col("upper")) if "lower" in scored.columns else F.lit(False)
    judged = F.col("predicts_full").isNotNull() & F.col("reaches_full").isNotNull()
    g = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("issued"), F.count("predicted").alias("with_point"), F.count_if(F.col("before_target") & F.col("predicted").isNotNull()).alias("before_target"), F.count_if(F.col("state") == "matched").alias("matched"), F.count_if(ordinary).alias("ordinary"), F.count_if("saturated").alias("saturated"),
        F.count_if(ordinary & banded).alias("banded"), F.avg(F.when(ordinary & banded, inside.cast("double"))).alias("coverage"), F.count_if(ordinary & (left - F.col("observed") >= 2) & (left - F.col("predicted") < 1)).alias("missed_bursts"), F.count_if(judged).alias("judged"),
        F.count_if(judged & F.col("predicts_full") & ~F.col("reaches_full")).alias("false_alarms"), F.count_if(judged & ~F.col("predicts_full") & F.col("reaches_full")).alias("missed_full"), F.count("warning_minutes").alias("warnings"), F.avg("warning_minutes").alias("warning_minutes"),
        F.avg(e).alias("signed"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )
    free = chronological_blocks(t.where(ordinary), by, "origin_us", "outcome_us", "resets_us", options.block_hours).where("block_id is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("independent"), F.count_distinct("block_id").alias("blocks"), F.sum("error").alias("accumulated"))
    states = t.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "state", F.col("k").cast("string")))), ",").alias("states"))
    on = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    out = g.join(free, on(g, free), "left").drop(*(free[c] for c in by))
    return out.join(states, on(out, states)).drop(*(states[c] for c in by)).fillna(0, ["independent", "blocks"])


# --- M43


def rolling_joint_comparison(observations: DataFrame, keys: list[str], candidates: dict[str, list[str]], first: int = 20, split: float = 0.8, options: Options = Options()) -> DataFrame:
    """Every feature set frozen and expanding (a ridge on all earlier rows), beside pace and nothing.  The first part of the held-out range
    chooses: the least block-balanced loss, if it beats the pace by a tenth and 0.1 points, else the pace.  `chosen` marks
    the policy whose loss on the last part counts."""
    observations = kept(observations, "cost-rows")
    frozen = cost_trials(observations, keys, candidates, first).select(*keys, "candidate", "start_us", "end_us", "resets_us", "predicted", "loss")
    frozen = frozen.withColumn("candidate", F.when(F.col("candidate").isin("zero", "pace"), F.col("candidate")).otherwise(F.concat(F.lit("frozen-"), F.col("candidate"))))
    parts = frozen_parts(observations, keys, first)
    o = parts.withColumn("moved", moved()).withColumnsRenamed({"start_us": "origin_us", "end_us": "outcome_us"})
    out = [frozen]
    for name, features in candidates.items():
        fit = ridge_before(o, keys, features, "moved", 1.0, 10**9).where("part = 'heldout' and issue is null").withColumn("predicted", F.greatest(F.lit(0.0), F.coalesce(ridge_apply(features), F.lit(0.0))))
        out.append(fit.select(*keys, F.lit(f"expanding-{name}").alias("candidate"), F.col("origin_us").alias("start_us"), F.col("outcome_us").alias("end_us"), "resets_us", "predicted", loss_of(F.col("predicted")).alias("loss")))
    t = kept(reduce(DataFrame.unionByName, out), "rolling")
    ends = t.groupBy(*keys).agg(F.min("start_us").alias("_a"), F.max("start_us").alias("_z"))
    t = t.join(ends, keys).withColumn("period", F.when(F.col("start_us") < F.col("_a") + (F.col("_z") - F.col("_a")) * split, "development").otherwise("final")).drop("_a", "_z")
    by = [*keys, "candidate", "period"]
    s = block_means(t, by, ["loss"], options.block_hours).groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), F.sum("block_rows").alias("rows"), F.avg("loss").alias("loss"))
    side = lambda period, n: s.where(F.col("period") == period).select(*keys, "candidate", F.col("blocks").alias(f"{n}_blocks"), F.col("loss").alias(f"{n}_loss"))
    j = side("development", "development").join(side("final", "final"), [*keys, "candidate"], "full")
    pace = j.where("candidate = 'pace'").select(*keys, F.col("development_loss").alias("_pace"))
    j = j.join(pace, keys, "left")
    wins = F.coalesce((F.col("development_loss") + options.margin_points < F.col("_pace")) & (F.col("development_loss") < F.col("_pace") * (1 - options.margin)), F.lit(False)) & ~F.col("candidate").isin("zero", "pace")
    order = Window.partitionBy(*keys).orderBy(F.desc(wins), F.when(wins, F.col("development_loss")), F.desc(F.col("candidate") == "pace"), "candidate")
    return j.withColumn("chosen", F.row_number().over(order) == 1).drop("_pace")


# --- M44, M45


def _scales(rows: DataFrame, keys: list[str], value: str, lower: str = "lower", upper: str = "upper", steps: int = 200) -> DataFrame:
    """keys, scale: what a frozen fit's value must be multiplied by to come closest to the envelopes; NULL for a fit that is zero.
    rows: a bounded number for each key."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, lo, up = (g[c].to_numpy(dtype=float) for c in (value, lower, upper))
        curve, scale = float((x * x).mean()), 0.0
        if curve <= 1e-12:
            return pd.DataFrame([[*g[keys].iloc[0], None]], columns=[*keys, "scale"])
        for _ in range(steps):
            new = max(0.0, scale - float((x * (x * scale - np.clip(x * scale, lo, up))).mean()) / curve)
            if abs(new - scale) < 1e-10:
                break
            scale = new
        return pd.DataFrame([[*g[keys].iloc[0], scale]], columns=[*keys, "scale"])

    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(fit, f"{ddl}, scale double")


def _closest(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The scale of each row of x that brings it closest to its envelope (a row for each, or one for all), and which rows are zero and have none."""
    curve = (x * x).mean(1)
    scale, live = np.zeros(len(x)), np.flatnonzero(curve > 1e-12)
    of = lambda bound: bound[live] if bound.ndim > 1 else bound
    for _ in range(steps):
        if not len(live):
            break
        y, old = x[live] * scale[live, None], scale[live]
        new = np.maximum(0.0, old - (x[live] * (y - np.clip(y, of(lower), of(upper)))).mean(1) / curve[live])
        moving = np.abs(new - old) >= 1e-10
        live = live[moving]
        scale[live] = new[moving]
    return scale, curve <= 1e-12


def _pair_scales(pairs: DataFrame, features: list[str], first: int, steps: int = 200) -> DataFrame:
    """pairs without their training arrays, with `scale` (as `_scales` fits it): many pairs at once.  pairs: donor_weights, and arrays of `first`
    training values: _x0, _x1, ... (the features), _lo, _up."""
    names = [c for c in pairs.columns if c not in ("_lo", "_up", *(f"_x{i}" for i in range(len(features))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = lambda c, n: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)  # noqa: E731, B023
            w = flat("donor_weights", len(features))
            x = sum(flat(f"_x{i}", first) * w[:, i : i + 1] for i in range(len(features)))
            scale, none = _closest(x, flat("_lo", first), flat("_up", first), steps)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scale, mask=none)], [*names, "scale"])

    return pairs.mapInArrow(run, T.StructType([*(pairs.schema[c] for c in names), T.StructField("scale", T.DoubleType())]))


#: About how many donors and how many cohorts meet in a unit of work, how many pairs a task makes, held-out rows that a cohort brings at once, and pairs in a batch of the result.
DONORS, COHORTS, TRANSFERS_PER_TASK, PIECE, TRANSFERS = 2048, 512, 500_000, 256, 32_768


def _lists(column: pa.ListArray, names: list[str]) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """A column of lists of numbers as one matrix, where each row's part of it begins (and the last ends), and the same as Arrow has it."""
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.column_stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names]), np.concatenate([[0], np.cumsum(sizes)]), flat


def _misses(predicted: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The losses of predictions (a row for each donor) on held-out rows (lower, upper, share), each with its share in the balanced mean."""
    return np.fmax(np.fmax(rows[:, 0] - predicted, predicted - rows[:, 1]), 0.0) @ rows[:, 2]


def _transfers(units: DataFrame, unit: list[str], own: list[str], d: int) -> DataFrame:
    """The pairs of each unit's donors and cohorts: own, donor, reused, rescaled.  units: rows sorted by unit, each unit's donors first (_donors, by the time
    until which they know), then cohorts (_from, _last, _train, _late), whose held-out rows may come in several pieces."""
    x = [f"_x{i}" for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None  # the unit whose donors are at hand
        for batch in batches:
            given, at_donor, flat = _lists(batch.column("_donors"), [f"_w{i}" for i in range(d)])
            donors, until = flat.field("donor"), flat.field("_until").to_numpy(zero_copy_only=False)
            train, at_train, _ = _lists(batch.column("_train"), [*x, "_lo", "_up"])
            late, at_late, _ = _lists(batch.column("_late"), [*x, "_lo", "_up", "_share"])
            begins, last = batch.column("_from").to_numpy(zero_copy_only=False), batch.column("_last").to_pylist()
            done, made = [], 0

            def pairs() -> pa.RecordBatch:
                rows, ids, reused, rescaled = zip(*done)  # noqa: B023
                mine = batch.select(own).take(pa.array(np.repeat(rows, [len(i) for i in ids])))  # noqa: B023
                return pa.RecordBatch.from_arrays([*mine.columns, pa.concat_arrays(ids), pa.array(np.concatenate(reused)), pa.array(np.concatenate(rescaled))], [*own, "donor", "reused", "rescaled"])

            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in unit))):
                a, z = at_donor[i], at_donor[i + 1]
                if z > a:
                    met, ids, ends, w = key, donors.slice(a, z - a), until[a:z], given[a:z]
                    continue
                if met != key:
                    continue
                rows = train[at_train[i] : at_train[i + 1]]
                if len(rows):
                    n = int(np.searchsorted(ends, begins[i], side="right"))
                    scale, none = _closest(w[:n] @ rows[:, :d].T, rows[:, d], rows[:, d + 1])
                    fits, reused, rescaled = np.flatnonzero(~none), np.zeros(n), np.zeros(n)
                if not n:
                    continue
                rows = late[at_late[i] : at_late[i + 1]]
                predicted = w[:n] @ rows[:, :d].T
                reused += _misses(predicted, rows[:, d:])
                rescaled[fits] += _misses(predicted[fits] * scale[fits, None], rows[:, d:])
                rescaled[none] += _misses(np.zeros((1, len(rows))), rows[:, d:])  # a fit that is zero stays zero at any scale
                if last[i]:
                    done.append((i, ids.slice(0, n), reused, rescaled))
                    made += n
                    if made >= TRANSFERS:
                        yield pairs()
                        done, made = [], 0
            if done:
                yield pairs()

    donor = units.schema["_donors"].dataType.elementType["donor"]
    return units.mapInArrow(run, T.StructType([*(units.schema[c] for c in own), donor, *(T.StructField(c, T.DoubleType()) for c in ("reused", "rescaled"))]))


def transfer_evaluation(observations: DataFrame, group: list[str], cohort: str, features: list[str], first: int = 20, options: Options = Options()) -> DataFrame:
    """The fits of earlier cohorts of the same group (the donors) on a later cohort's held-out rows: as they are, with one scale fitted on its first
    rows, and beside its own fit.  There is a row for each cohort and donor, so work grows with the square of a group's cohorts.  Parts of the
    donors meet parts of the cohorts in units of bounded size; a pair is made whole there and leaves as a row of the result, so no pairs are shuffled."""
    keys = [*group, cohort]
    observations = kept(observations, "cost-rows")
    parts = kept(frozen_parts(observations, keys, first).where("issue is null"), "transfer-rows")
    fit = interval_ridge(parts.where("part = 'training'"), keys, features, first).select(*keys, "weights")
    spans = parts.groupBy(*keys).agg(F.min("start_us").alias("_from"), F.max("end_us").alias("_to"))
    fit = kept(fit.join(spans, keys), "transfer-fits")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    inputs = {f"_x{i}": number(f) for i, f in enumerate(features)}
    seen = [*(v.alias(n) for n, v in inputs.items()), F.col("lower").cast("double").alias("_lo"), F.col("upper").cast("double").alias("_up")]
    train = parts.where("part = 'training'").groupBy(*keys).agg(F.collect_list(F.struct(*seen)).alias("_train")).withColumn("_piece", F.lit(0))
    late = chronological_blocks(parts.where("part = 'heldout'"), keys, hours=options.block_hours).where("block_id is not null").join(fit.select(*keys, "weights", "_from"), keys)
    late = kept(late.select(*keys, "_from", "start_us", "block_id", *seen, loss_of(cost_of(features)).alias("local"), loss_of(F.lit(0.0)).alias("nothing")), "transfer-late")
    own = late.groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("rows"), F.avg("local").alias("local"), F.avg("nothing").alias("nothing"))
    own = own.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("blocks"), F.avg("local").alias("local"), F.avg("nothing").alias("nothing"))

    whole = Window.partitionBy(*keys)
    piece = late.drop("local", "nothing").join(own, keys).withColumn("_share", 1.0 / (F.count(F.lit(1)).over(Window.partitionBy(*keys, "block_id")) * F.col("blocks")))
    piece = piece.withColumn("_piece", F.floor((F.row_number().over(whole.orderBy("start_us")) - 1) / PIECE).cast("int")).withColumn("_last", F.col("_piece") == F.floor((F.col("rows") - 1) / PIECE))
    scores = ["rows", "blocks", "local", "nothing"]
    piece = piece.groupBy(*keys, "_piece").agg(*(F.first(c).alias(c) for c in ("_from", "_last", *scores)), F.collect_list(F.struct(*inputs, "_lo", "_up", "_share")).alias("_late")).join(train, [*keys, "_piece"], "left")

    sizes = fit.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).select(*group, "_n", F.ceil(F.col("_n") / DONORS).cast("int").alias("_deals"), F.ceil(F.col("_n") / COHORTS).cast("int").alias("_slices"))
    tasks = (sizes.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()[0] or 0) // TRANSFERS_PER_TASK + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    donor = F.struct(F.col("_to").alias("_until"), F.col(cohort).alias("donor"), *(F.element_at("weights", i + 1).alias(f"_w{i}") for i in range(len(features))))
    donors = fit.join(sizes, group).groupBy(*group, "_slices", F.pmod(F.xxhash64(cohort), "_deals").cast("int").alias("_deal")).agg(F.array_sort(F.collect_list(donor)).alias("_donors"))
    donors = donors.select(*group, "_deal", every("_slices").alias("_slice"), "_donors")
    mine = piece.join(sizes, group).withColumn("_slice", F.pmod(F.xxhash64(cohort, F.lit("slice")), "_slices").cast("int")).withColumn("_deal", every("_deals")).drop("_n", "_deals", "_slices")
    unit = [*group, "_deal", "_slice"]
    units = donors.unionByName(mine, allowMissingColumns=True).repartition(int(tasks), *unit).sortWithinPartitions(*unit, F.col(cohort).asc_nulls_first(), "_piece")
    return _transfers(units, unit, [*keys, *scores], len(features)).select(*keys, "donor", "rows", "blocks", "reused", "rescaled", "local", "nothing")


def aligned_window_study(pairs: DataFrame, keys: list[str], features: list[str], first: int = 20, options: Options = Options()) -> DataFrame:
    """Two meters over identical work: does each need weights of its own, or is one the other times a scale?

    pairs: keys, start_us, end_us, resets_us, features, and lower, upper, moved of either meter with the prefixes left_ and right_.  Both meters are
    fitted on the first rows; each fit is also scaled to the other meter on these rows.  The later rows give, for either meter, the block-balanced loss of its
    own fit (separate), of the other's scaled fit (shared) and of nothing.
    """
    whole = Window.partitionBy(*keys)
    pairs = kept(pairs, "aligned")
    o = pairs.withColumn("_n", F.row_number().over(whole.orderBy("start_us", "end_us")))
    o = o.withColumns({"_end": F.max(F.when(F.col("_n") <= first, F.col("end_us"))).over(whole), "_all": F.count(F.lit(1)).over(whole)}).where(F.col("_all") >= first)
    train = o.where(F.col("_n") <= first).select(*keys, *(F.col(f).cast("double").alias(f) for f in features), *(f"{s}_{c}" for s in ("left", "right") for c in ("lower", "upper")))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = g[features].to_numpy()
        w = [nonnegative_ridge(x, g[f"{s}_lower"].to_numpy(), g[f"{s}_upper"].to_numpy()).tolist() for s in ("left", "right")]
        return pd.DataFrame([[*g[keys].iloc[0], *w]], columns=[*keys, "left_weights", "right_weights"])

    ddl = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)
    fits = train.groupBy(*keys).applyInPandas(fit, f"{ddl}, left_weights array<double>, right_weights array<double>")
    j = o.join(fits, keys).withColumns({"left_own": cost_of(features, "left_weights"), "right_own": cost_of(features, "right_weights")})
    j = kept(j, "aligned-fits")
    seen = j.where(F.col("_n") <= first)
    for a, b in (("left", "right"), ("right", "left")):
        scale = _scales(seen.select(*keys, f"{b}_own", f"{a}_lower", f"{a}_upper"), keys, f"{b}_own", f"{a}_lower", f"{a}_upper").withColumnRenamed("scale", f"{a}_scale")
        j = j.join(scale, keys, "left")
    late = j.where((F.col("_n") > first) & (F.col("start_us") >= F.col("_end")))
    out = []
    for a, b in (("left", "right"), ("right", "left")):
        loss = lambda v: interval_loss(v, F.col(f"{a}_lower"), F.col(f"{a}_upper"))  # noqa: E731, B023
        shared = F.col(f"{b}_own") * F.col(f"{a}_scale")
        t = late.where(F.col(f"{a}_scale").isNotNull()).withColumns({"separate": loss(F.col(f"{a}_own")), "shared": loss(shared), "nothing": loss(F.lit(0.0)), "signed": shared - F.col(f"{a}_moved"), "scale": F.col(f"{a}_scale")})
        m = block_means(t, keys, ["separate", "shared", "nothing", "signed", "scale"], options.block_hours)
        out.append(m.groupBy(*keys).agg(F.lit(a).alias("meter"), F.sum("block_rows").alias("rows"), F.count(F.lit(1)).alias("blocks"), F.first("scale").alias("scale"), *(F.avg(c).alias(c) for c in ("separate", "shared", "nothing", "signed"))))
    return reduce(DataFrame.unionByName, out)


# --- M46, M47


def tt_evaluation(observations: DataFrame, keys: list[str], features: list[str], first: int = 20, options: Options = Options()) -> DataFrame:
    """A basis frozen on the first rows, one scale fitted to it on the next ones, scored on the rest beside weights of all features and of the raw total fitted on
    the same rows as the scale, and nothing.  The cumulative error has bounds: the envelopes' sums."""
    observations = kept(observations, "cost-rows")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start_us", "end_us"))
    raw = sum((F.col(f) for f in features[1:]), F.col(features[0])).cast("double")
    o = observations.withColumns({"_n": n, "raw": raw}).join(interval_ridge(observations, keys, features, first).where(F.col("n") >= first).select(*keys, "weights"), keys)
    o = kept(o.withColumn("score", cost_of(features)), "scores")
    mid = o.where((F.col("_n") > first) & (F.col("_n") <= 2 * first))
    enough = mid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.max("end_us").alias("_end")).where(F.col("_k") >= first)
    scale = _scales(mid.select(*keys, "score", "lower", "upper"), keys, "score")
    vector = interval_ridge(mid, keys, features, first).select(*keys, F.col("weights").alias("_vector"))
    total = interval_ridge(mid, keys, ["raw"], first).select(*keys, F.col("weights").alias("_total"))
    late = o.where(F.col("_n") > 2 * first).join(enough, keys).where(F.col("start_us") >= F.col("_end"))
    late = late.join(scale, keys).join(vector, keys).join(total, keys).where("scale is not null")
    scalar = F.col("score") * F.col("scale")
    late = late.withColumns({"scalar": scalar, "scalar_loss": loss_of(scalar), "vector_loss": loss_of(cost_of(features, "_vector")), "raw_loss": loss_of(cost_of(["raw"], "_total")), "zero_loss": loss_of(F.lit(0.0))})
    late = kept(late, "scored")
    losses = ["scalar_loss", "vector_loss", "raw_loss", "zero_loss"]
    b = block_means(late, keys, losses, options.block_hours).groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), *(F.avg(c).alias(c) for c in losses))
    g = late.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.first("scale").alias("scale"), (F.sum("scalar") - F.sum(moved())).alias("cumulative_error"), (F.sum("scalar") - F.sum("upper")).alias("least_error"), (F.sum("scalar") - F.sum("lower")).alias("greatest_error"))
    return g.join(b, keys)


def session_quota_evaluation(hurdles: DataFrame, observations: DataFrame, keys: list[str], horizon_us: int, first: int = 20, options: Options = Options()) -> DataFrame:
    """The tokens that the hurdle model expects at an interval's start, times the frozen cost of a token, against what the meter moved; beside the pace, the incumbent and nothing.

    hurdles: origin_us, probability, conditional_mean for `horizon_us` (of all work; the latest by the start and within a horizon counts).
    `conditional` is scored on the intervals with work only.  Intervals without a usable hurdle or fit are withheld.
    """
    observations, hurdles = kept(observations, "cost-rows"), kept(hurdles, "hurdles")
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])).cast("double")
    o = frozen_parts(observations.withColumn("all_tokens", total), keys, first).where("part = 'heldout'")
    fit = interval_ridge(observations.withColumn("all_tokens", total), keys, ["all_tokens"], first).select(*keys, F.element_at("weights", 1).alias("_per_token"))
    spans = hurdles.select("origin_us", (F.col("origin_us") + horizon_us).alias("_until"), "probability", "conditional_mean")
    ask = o.select(F.col("start_us").alias("_at")).distinct()
    near = range_join(ask, spans, [], "_at", "origin_us", "_until", horizon_us, levels=[0]).groupBy(F.col("_at").alias("start_us")).agg(F.max_by(F.struct("probability", "conditional_mean"), "origin_us").alias("_h"))
    j = o.join(near, "start_us", "left").join(fit, keys, "left")
    hours = (F.col("end_us") - F.col("start_us")) / horizon_us
    conditional = F.col("_h.conditional_mean") * hours * F.col("_per_token")
    j = j.withColumns({"conditional": conditional, "predicted": conditional * F.col("_h.probability"), "actual": moved(), "withheld": F.coalesce(F.col("issue"), F.when(conditional.isNull(), "no-hurdle"))})
    j = kept(j, "session-trials")
    t = j.where("withheld is null").withColumn("error", F.abs(F.col("predicted") - F.col("actual")))
    t = with_band(block_maxima_before(t, keys, "error", options, start="start_us", end="end_us", strict=False).drop("lower", "upper"), options, high=None).withColumnsRenamed({"lower": "_low", "upper": "_high"})
    t = t.join(observations.select(*keys, "start_us", "end_us", "lower", "upper"), [*keys, "start_us", "end_us"])
    away = lambda c: F.abs(F.col(c) - F.col("actual"))
    active = F.col("events") > 0
    banded = F.col("radius").isNotNull()
    g = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(active).alias("active"), F.avg(F.when(active, away("conditional"))).alias("conditional_mae"), F.avg("error").alias("expected_mae"), F.avg(away("pace_delta")).alias("pace_mae"), F.avg(away("incumbent_delta")).alias("incumbent_mae"), F.avg(F.abs("actual")).alias("nothing_mae"),
        F.avg(loss_of(F.col("predicted"))).alias("expected_loss"), F.avg(loss_of(F.col("pace_delta"))).alias("pace_loss"), F.count_if(banded).alias("bands"), F.avg(F.when(banded, F.col("actual").between(F.col("_low"), F.col("_high")).cast("double"))).alias("covered"), F.avg(F.col("_high") - F.col("_low")).alias("width"),
    )
    why = j.where("withheld is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("withheld"))
    return j.select(*keys).distinct().join(g, keys, "left").join(why, keys, "left").fillna(0, ["trials", "active", "bands", "withheld"])


# --- M35


def plan_fit(continued: DataFrame, lanes: DataFrame, keys: list[str], features: list[str], hours: float) -> DataFrame:
    """The work carried on from each meter's last reading: its cost by the meter's frozen weights, what the pace alone would take, and
    whether the plan fits before the reset.  continued: continue_workload's cells at the readings' times; lanes: reset_outlook's columns with weights."""
    work = continued.groupBy("origin_us").agg(*(F.sum(c).cast("double").alias(c) for c in features))
    j = lanes.join(work, lanes["us"] == work["origin_us"], "left").drop("origin_us")
    cost = F.when(F.col(features[0]).isNotNull(), cost_of(features))
    j = j.withColumns({"cost": cost, "pace_use": F.col("rate") * hours, "left": 100.0 - F.col("used")})
    fit = (
        F.when(F.col("cost").isNull(), "no-recent-work").when(F.col("us") + int(hours * HOUR_US) > F.col("resets_us"), "crosses-reset")
        .when(F.greatest("cost", "pace_use") <= F.col("left"), "fits").when(F.least("cost", "pace_use") > F.col("left"), "exceeds").otherwise("uncertain")
    )
    return j.select(*keys, "us", "cost", "pace_use", "left", fit.alias("fit"))
