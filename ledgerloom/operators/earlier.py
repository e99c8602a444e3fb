"""Exact quantiles of everything that came before (the bands of M22), without lists of the past.

The k-th smallest of a block's predecessors is found by descending the bits of the values' ranks: at each level one running count says how many
predecessors lie in the lower half.  A level is a window by (key, node), so memory does not grow with the past and a long key is
spread over its nodes from the second level on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .forecasting import Options
from .sequence import chronological_blocks

#: Levels after which the plan is cut.
LEVELS_A_PLAN = 6


def earlier_order_statistics(blocks: DataFrame, keys: list[str], order: str, value: str, place: Callable[[Column], Column]) -> DataFrame:
    """(keys, order, before, low, high): how many rows of the key come before each row in `order` (unique within it), and the (k-1)-th and
    k-th smallest of their values, k = place(before + 1); null where there is none.  Rows without a value do not count and get no row."""
    by_value, by_order = Window.partitionBy(*keys).orderBy(value, order), Window.partitionBy(*keys).orderBy(order)
    items = blocks.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"), (F.row_number().over(by_value) - 1).alias("_r"), (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("_m"))
    items = kept(items, "ranked-blocks")
    bits = int(items.agg(F.max("_r")).first()[0] or 0).bit_length()
    k = place(F.col("_m") + 1)
    asked = items.select(*keys, "_o", F.explode(F.array(k - 1, k)).alias("_want"), "_m", k.alias("_k")).withColumn("_high", F.col("_want") == F.col("_k"))
    asked = asked.where((F.col("_want") >= 1) & (F.col("_want") <= F.col("_m"))).select(*keys, "_o", "_high", F.col("_want").cast("long").alias("_want"), F.lit(0).cast("long").alias("_base"))
    for level, b in enumerate(reversed(range(bits))):
        node = lambda c, b=b: F.shiftright(F.col(c).cast("long"), b)
        seen = items.select(*keys, "_o", F.lit(None).cast("boolean").alias("_high"), F.lit(None).cast("long").alias("_want"), F.lit(None).cast("long").alias("_base"), node("_r").alias("_node"), F.lit(1).alias("_item"))
        both = asked.withColumns({"_node": node("_base"), "_item": F.lit(0)}).unionByName(seen)
        lower = F.sum("_item").over(Window.partitionBy(*keys, "_node").orderBy("_o", "_item").rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("_lower", lower).where("_item = 0")
        right = F.col("_want") > F.col("_lower")
        asked = both.select(*keys, "_o", "_high", F.when(right, F.col("_want") - F.col("_lower")).otherwise(F.col("_want")).alias("_want"), F.when(right, F.col("_base") + (1 << b)).otherwise(F.col("_base")).alias("_base"))
        if level % LEVELS_A_PLAN == LEVELS_A_PLAN - 1:
            asked = kept(asked, "descent")
    found = asked.join(items.select(*keys, F.col("_r").cast("long").alias("_base"), "_v"), [*keys, "_base"])
    found = found.groupBy(*keys, "_o").agg(F.max(F.when(~F.col("_high"), F.col("_v"))).alias("low"), F.max(F.when(F.col("_high"), F.col("_v"))).alias("high"))
    return items.join(found, [*keys, "_o"], "left").select(*keys, F.col("_o").alias(order), F.col("_m").cast("long").alias("before"), "low", "high")


def bands_before(trials: DataFrame, keys: list[str], error: str, options: Options = Options(), start: str = "start_us", end: str = "end_us", strict: bool = True) -> DataFrame:
    """trials with `blocks_before` and `radius`: the rank quantile of the greatest errors of all chronological blocks before, made of the rows
    that ended before the row's start (strict) or by it; the unfinished block counts as far as it has come.  NULL with too few blocks.

    With x for the unfinished block the k-th smallest is between the (k-1)-th and the k-th of the finished ones."""
    place = lambda n: F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * options.coverage).cast("int")))
    b = kept(chronological_blocks(trials, keys, start, end, "resets_us", options.block_hours).where("block_id is not null").select(*keys, "block_id", F.col(end).alias("_t"), F.col(error).alias("_x")), "block-rows")
    past = earlier_order_statistics(b.groupBy(*keys, "block_id").agg(F.max("_x").alias("_m")), keys, "block_id", "_m", place)
    so_far = F.max("_x").over(Window.partitionBy(*keys, "block_id").orderBy("_t"))
    state = b.withColumn("_so_far", so_far).join(past, [*keys, "block_id"])
    band = F.struct((F.col("before") + 1).alias("n"), F.least(F.greatest("low", "_so_far"), F.col("high")).alias("q"))
    row = F.struct(*(F.col(c) for c in trials.columns))
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("r")).schema["r"].dataType)
    told = state.select(*keys, "_t", F.lit(1 if strict else 0).alias("_q"), band.alias("_band"), none(row, trials).alias("_row"))
    asked = trials.select(*keys, F.col(start).alias("_t"), F.lit(0 if strict else 1).alias("_q"), none(band, state).alias("_band"), row.alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(asked).select("_row", F.last("_band", True).over(w).alias("_band")).where("_row is not null")
    n = F.coalesce(F.col("_band.n"), F.lit(0).cast("long"))
    return both.select(*(F.col(f"_row.{c}").alias(c) for c in trials.columns), n.alias("blocks_before"), F.when(n >= options.least_groups, F.col("_band.q")).alias("radius"))
