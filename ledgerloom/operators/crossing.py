"""When a shared path of work first uses up an allowance, over several windows with declared resets.

A path's steps cost something in each window; both costs come from one step, so paths are never drawn anew for a window.  A window's
allowance lasts to its reset; resets that were declared by the origin open further segments with allowances of their own, and beyond the last
one nothing is known.  Steps are split where any window's segment ends, evenly in time; a path's first crossing is a piece, not a moment.

Paths are censored: crossed, no-crossing, or unresolved (a reset without a declared allowance before the target, a step whose cost is no
number, an allowance that runs out exactly at its reset).  All keep their share; times are conditional on the paths that crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: An allowance that is met this closely at a reset is met exactly.
EXACT = 1e-12
MINUTE_US = 60_000_000.0


def segments(budgets: DataFrame, resets: DataFrame, keys: list[str]) -> DataFrame:
    """budgets: keys, window, origin_us, remaining, reset_us; resets: keys, window, at_us, next_us, remaining, declared_us ->
    keys, window, from_us, to_us, remaining: only resets declared by the origin that follow one another without a gap."""
    first = budgets.select(*keys, "window", "origin_us", F.col("origin_us").alias("from_us"), F.col("reset_us").alias("to_us"), F.col("remaining").cast("double").alias("remaining"))
    more = resets.join(budgets.select(*keys, "window", "origin_us"), [*keys, "window"]).where(F.col("declared_us") <= F.col("origin_us"))
    both = first.unionByName(more.select(*keys, "window", "origin_us", F.col("at_us").alias("from_us"), F.col("next_us").alias("to_us"), F.col("remaining").cast("double").alias("remaining")))
    w = Window.partitionBy(*keys, "window").orderBy("from_us", "to_us")
    gap = (F.col("from_us") != F.coalesce(F.lag("to_us").over(w), F.col("from_us"))) | (F.col("to_us") <= F.col("from_us")) | F.col("remaining").isNull() | ~F.col("remaining").between(0, 100)
    broken = F.sum(gap.cast("int")).over(w)
    return both.withColumn("_broken", broken).where("_broken = 0").drop("_broken", "origin_us")


def _horizon(segs: DataFrame, budgets: DataFrame, keys: list[str], through_us: Column) -> DataFrame:
    """keys, origin_us, through_us, support_us (to where all windows are known), cap_us, cuts, and each window's segments."""
    ends = segs.groupBy(*keys, "window").agg(F.max("to_us").alias("end"), F.sort_array(F.collect_list(F.struct("from_us", "to_us", "remaining"))).alias("segs"))  # a declared schedule
    lists = ends.groupBy(*keys).agg(F.min("end").alias("support_us"), F.map_from_entries(F.collect_list(F.struct("window", "segs"))).alias("segs"))
    origin = budgets.groupBy(*keys).agg(F.min("origin_us").alias("origin_us"), F.count_distinct("window").alias("_windows"))
    out = lists.join(origin, keys).withColumn("through_us", through_us).where(F.size("segs") == F.col("_windows"))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.map_values("segs")), lambda s: F.array(s["from_us"], s["to_us"])))))
    return out.withColumns({"cap_us": F.least("support_us", "through_us"), "cuts": cuts}).drop("_windows")


def crossing_outcomes(steps: DataFrame, budgets: DataFrame, resets: DataFrame, keys: list[str], through_us: Column) -> DataFrame:
    """Keys, path, state, known_through_us, from_us and through_us of the first crossing, its windows, and the reason of an unresolved path.

    steps: keys, path, from_us, to_us, costs (window -> percentage points), contiguous from the origin.  through_us: the target, an expression
    over keys and origin_us.  Origins whose current allowance is no percentage have no outcomes."""
    segs = segments(budgets, resets, keys)
    spans = kept(_horizon(segs, budgets, keys, through_us), "horizons")
    s = steps.join(spans, keys)
    paths = s.select(*keys, "path", "origin_us", "through_us", "support_us", "cap_us", "segs").dropDuplicates([*keys, "path"])
    s = s.where(F.col("from_us") < F.col("cap_us")).withColumn("end", F.least("to_us", "cap_us"))
    inner = F.filter("cuts", lambda x: (x > F.col("from_us")) & (x < F.col("end")))
    s = s.withColumn("at", F.concat(F.array("from_us"), inner, F.array("end")))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("at") - 1))).withColumns({"a": F.element_at("at", F.col("i")), "b": F.element_at("at", F.col("i") + 1)})
    s = s.select(*keys, "path", "from_us", "to_us", "a", "b", "support_us", "costs", F.explode("segs").alias("window", "own"))
    cost = F.element_at("costs", F.col("window"))
    s = s.withColumns({"cost": cost, "seg": F.element_at(F.filter("own", lambda x: (x["from_us"] <= F.col("a")) & (F.col("a") < x["to_us"])), 1)}).drop("own", "costs")
    invalid = F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") < 0) | (F.col("cost") == float("inf"))
    s = s.withColumn("invalid", invalid).withColumn("part", F.when(~invalid, F.col("cost") * (F.col("b") - F.col("a")) / (F.col("to_us") - F.col("from_us"))))
    before = F.coalesce(F.sum("part").over(Window.partitionBy(*keys, "path", "window", "seg.from_us").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("left", F.greatest(F.lit(0.0), F.col("seg.remaining") - before))
    met = F.coalesce(F.col("part") >= F.col("left"), F.lit(False))
    tie = met & ((F.col("b") == F.col("seg.to_us")) | (F.col("b") == F.col("support_us"))) & (F.abs(F.col("part") - F.col("left")) <= EXACT)
    empty = (F.col("seg.from_us") == F.col("a")) & (F.col("seg.remaining") == 0)
    named = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("window"))))
    pieces = s.groupBy(*keys, "path", "from_us", "a", "b").agg(F.bool_or("invalid").alias("invalid"), named(empty).alias("empty"), named(met).alias("met"), F.bool_or(met & ~tie).alias("definite"), F.bool_or(tie).alias("tie"))
    known = lambda state, through, a, b, windows, reason: F.struct(F.lit(state).alias("state"), through.alias("known_through_us"), a.alias("from_us"), b.alias("through_us"), windows.alias("windows"), reason.alias("reason"))
    none, nothing, no_reason = F.lit(None).cast("long"), F.array().cast("array<string>"), F.lit(None).cast("string")
    a, b = F.col("a"), F.col("b")
    first = Window.partitionBy(*keys, "path", "from_us").orderBy("a")
    found = (
        F.when(F.col("invalid") & (F.row_number().over(first) == 1), known("unresolved", F.col("from_us"), none, none, nothing, F.lit("invalid-step-cost")))
        .when(F.size("empty") > 0, known("crossed", a, a, a, F.col("empty"), no_reason)).when(F.col("definite"), known("crossed", b, a, b, F.col("met"), no_reason))
        .when(F.col("tie"), known("unresolved", b, none, none, nothing, F.lit("reset-order-tie")))
    )
    hits = pieces.withColumn("found", found).where("found is not null").groupBy(*keys, "path").agg(F.min_by("found", "a").alias("found"))
    out = paths.join(hits, [*keys, "path"], "left")
    # what stands at the origin and at the end of what is known
    zero = lambda at: F.sort_array(F.map_keys(F.map_filter("segs", lambda k, v: F.exists(v, lambda x: (x["from_us"] == at) & (x["remaining"] == 0)))))
    cap, origin = F.col("cap_us"), F.col("origin_us")
    end = F.when(F.size(zero(cap)) > 0, known("crossed", cap, cap, cap, zero(cap), no_reason)).when(F.col("support_us") <= F.col("through_us"), known("unresolved", cap, none, none, nothing, F.lit("unsupported-reset"))).otherwise(known("no-crossing", F.col("through_us"), none, none, nothing, no_reason))
    result = F.when(F.size(zero(origin)) > 0, known("crossed", origin, origin, origin, zero(origin), no_reason)).otherwise(F.coalesce("found", end))
    return out.withColumn("r", result).select(*keys, "path", "origin_us", "r.*") if "origin_us" not in keys else out.withColumn("r", result).select(*keys, "path", "r.*")


def crossing_report(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of crossed, no-crossing and unresolved paths, which add up, and the times of those that crossed, in minutes from the origin."""
    minutes = F.when(F.col("state") == "crossed", (F.col("through_us") - F.col("origin_us")) / MINUTE_US)
    of = lambda state: F.count_if(F.col("state") == state)
    g = outcomes.withColumn("minutes", minutes).groupBy(*dict.fromkeys([*keys, "origin_us"])).agg(
        F.count(F.lit(1)).alias("paths"), of("crossed").alias("crossed"), of("no-crossing").alias("no_crossing"), of("unresolved").alias("unresolved"),
        *(F.expr(f"percentile_disc({q}) within group (order by minutes)").alias(n) for n, q in (("p10_minutes", 0.1), ("p50_minutes", 0.5), ("p90_minutes", 0.9))),
    )
    return g.withColumns({f"{c}_share": F.col(c) / F.col("paths") for c in ("crossed", "no_crossing", "unresolved")})


def crossing_windows(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """In how many paths each window is among the first to run out."""
    return outcomes.where("state = 'crossed'").select(*dict.fromkeys([*keys, "origin_us"]), F.explode("windows").alias("window")).groupBy(*dict.fromkeys([*keys, "origin_us"]), "window").agg(F.count(F.lit(1)).alias("paths"))
