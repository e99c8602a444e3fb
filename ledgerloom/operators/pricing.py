"""Prices and weights of workloads (A18 to A22), exact in decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES, directed_ratio

EXACT = "decimal(38,6)"


def unpivot(df: DataFrame, ids: list[str], columns=CATEGORIES, name: str = "category", value: str = "tokens") -> DataFrame:
    return df.unpivot(ids, list(columns), name, value)


def fixed_price_weight(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Price-weighted tokens; what has no price is counted, not guessed.  prices: model, category, price."""
    cells = unpivot(events.select("event_id", "model", *CATEGORIES), ["event_id", "model"]).where("tokens > 0")
    j = cells.join(prices, ["model", "category"], "left")
    priced = F.col("price").isNotNull()
    per = j.groupBy("event_id").agg(F.sum((F.col("tokens").cast(EXACT) * F.col("price")).cast(EXACT)).alias("w"), F.coalesce(F.sum(F.when(priced, F.col("tokens"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(~priced, F.col("tokens"))), F.lit(0)).alias("u"))
    return per.agg(F.sum("w").alias("weight"), F.sum("p").cast("long").alias("priced_tokens"), F.sum("u").cast("long").alias("unpriced_tokens"), F.count_if(F.expr("u = 0")).alias("priced_events"), F.count_if(F.expr("u > 0")).alias("unpriced_events"))


def price_valuation(items: DataFrame, source: str = "price_source", price: str = "price", amount: str = "total") -> DataFrame:
    """Covered amount, full amount (NULL when anything is unpriced) and each source's part.  A negative or
    missing amount makes the whole valuation Inconsistent."""
    bad = F.col(amount).isNull() | (F.col(amount) < 0)
    value = (F.col(amount).cast(EXACT) * F.col(price)).cast(EXACT) / 1_000_000
    by = items.groupBy(F.col(source).alias("source")).agg(F.sum(value.cast("decimal(38,12)")).alias("amount"), F.sum(amount).cast("long").alias("tokens"), F.count_if(bad).alias("bad"))
    r = by.rollup("source").agg(F.grouping("source").alias("whole"), F.sum("amount").alias("covered"), F.sum("tokens").cast("long").alias("tokens"), F.sum(F.when(F.col("source").isNull(), F.col("tokens")).otherwise(0)).cast("long").alias("unpriced"), F.sum("bad").cast("long").alias("bad"))
    state = F.when(F.col("bad") > 0, "Inconsistent").when(F.col("unpriced") > 0, "Partial").otherwise("Complete")
    label = F.when(F.col("whole") == 1, "(all)").otherwise(F.coalesce("source", F.lit("(none)")))
    return r.select(label.alias("source"), "covered", "tokens", "unpriced", state.alias("state"), F.when(state == "Complete", F.col("covered")).alias("full_amount"))


def tt_score_exact(cells: DataFrame, weights: DataFrame, reference: float, dims: list[str]) -> DataFrame:
    """Weighted tokens over a reference; NULL if any cell has no weight."""
    from .joins import weight_join

    j = weight_join(cells, weights, dims)
    unsupported = F.bool_or(F.col("weight").isNull() & (F.col("tokens") > 0))
    total = F.sum((F.col("tokens").cast(EXACT) * F.col("weight")).cast(EXACT))
    return j.agg(total.alias("covered"), unsupported.alias("unsupported")).select("covered", "unsupported", F.when(~F.col("unsupported"), (F.col("covered") / F.lit(reference)).cast("double")).alias("score"))


def tt_score_bounds(rows: DataFrame, reference: float) -> DataFrame:
    """The least and greatest score that rows with unknown categories allow.

    rows: five nullable categories, their weights w_<category>, `total` (nullable).  What the known categories
    leave of the total goes to the unknown ones: by the smallest weight at least, by the largest at most.
    """
    known = [F.coalesce(F.col(c), F.lit(0)) for c in CATEGORIES]
    fixed = known[0] + known[1] + known[2] + known[3] + known[4]
    free = [F.when(F.col(c).isNull(), F.col(f"w_{c}")) for c in CATEGORIES]
    any_free = F.coalesce(*(F.when(F.col(c).isNull(), True) for c in CATEGORIES), F.lit(False))
    rest = F.col("total") - fixed
    base = sum((F.coalesce(F.col(c) * F.col(f"w_{c}"), F.lit(0.0)) for c in CATEGORIES[1:]), F.coalesce(F.col(CATEGORIES[0]) * F.col(f"w_{CATEGORIES[0]}"), F.lit(0.0)))
    state = (
        F.when(F.least(*(F.coalesce(F.col(c), F.lit(0)) for c in CATEGORIES)) < 0, "Inconsistent").when(F.col("total").isNotNull() & (rest < 0), "Inconsistent")
        .when(~any_free & F.col("total").isNotNull() & (rest != 0), "Inconsistent").when(any_free & F.col("total").isNull(), "Unbounded").when(any_free & (rest > 0), "FiniteBounds").otherwise("Exact")
    )
    r = rows.withColumn("_state", state).withColumn("_low", base + F.when(any_free & (rest > 0), F.least(*free) * rest).otherwise(0.0)).withColumn("_high", base + F.when(any_free & (rest > 0), F.greatest(*free) * rest).otherwise(0.0))
    g = r.agg(*(F.count_if(F.col("_state") == s).alias(s) for s in ("Inconsistent", "Unbounded", "FiniteBounds", "Exact")), F.sum("_low").alias("low"), F.sum("_high").alias("high"))
    whole = F.when(F.col("Inconsistent") > 0, "Inconsistent").when(F.col("Unbounded") > 0, "Unbounded").when(F.col("FiniteBounds") > 0, "FiniteBounds").otherwise("Exact")
    return g.withColumn("state", whole).select("state", "Inconsistent", "Unbounded", "FiniteBounds", "Exact", F.when(whole != "Inconsistent", F.col("low") / reference).alias("low"), F.when(whole.isin("FiniteBounds", "Exact"), F.col("high") / reference).alias("high"))


def basis_id(weights: DataFrame, dims: list[str]) -> DataFrame:
    """The normaliser and a canonical id of a weight basis."""
    row = F.to_json(F.struct(*dims, "category", F.col("weight").cast("string").alias("weight")))
    return weights.agg(F.sum(F.col("weight").cast(EXACT)).alias("normaliser"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("basis_id"), F.count(F.lit(1)).alias("cells"))


def extends_basis(old: DataFrame, new: DataFrame, dims: list[str]) -> DataFrame:
    """Cells of the old basis that the new one lacks or weighs otherwise; none means a compatible extension."""
    return old.join(new, [*dims, "category", "weight"], "left_anti")


__all__ = ["basis_id", "directed_ratio", "extends_basis", "fixed_price_weight", "price_valuation", "tt_score_bounds", "tt_score_exact", "unpivot"]
