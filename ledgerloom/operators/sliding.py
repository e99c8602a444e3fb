"""What the time before each origin holds, (origin - lookback, origin], by running sums within buckets of time.

An event counts from its time (or a later one, from which it is known) until `lookback` after it.  A bucket is as long as `lookback`, so such a
piece touches two buckets at most: in the second it is one of those that are carried in, which are added up.  Rows grow with events and origins, not
with their pairs, and no bucket needs another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: str, width: int) -> Column:
    return F.floor(F.col(at) / width)


def asked(origins: DataFrame, width: int) -> DataFrame:
    return origins.select("origin_us").where("origin_us is not null").distinct().select("origin_us", _bucket("origin_us", width).alias("_b"), F.col("origin_us").alias("_t"), F.lit(1).alias("_q"))


def active_at(pieces: DataFrame, origins: DataFrame, width: int, by: list[str], values: list[str]) -> DataFrame:
    """origin_us, by, values: the sums over the pieces [_s, _e) that hold the origin, for each origin and each `by` of its bucket.

    pieces: by, _s, _e, values (whole numbers); none is longer than `width`.
    """
    p = pieces.where("_s < _e").withColumns({"_first": _bucket("_s", width), "_b": _bucket("_e", width)})
    total = lambda sign: [(sign * F.sum(v)).alias(v) for v in values]
    begin = p.groupBy(*by, F.col("_first").alias("_b"), F.col("_s").alias("_t")).agg(*total(1))
    end = p.groupBy(*by, "_b", F.col("_e").alias("_t")).agg(*total(-1))
    carried = p.where("_first < _b").groupBy(*by, "_b").agg(*total(1)).withColumn("_t", F.col("_b") * width)
    none = F.lit(None).cast("long").alias("origin_us")
    moves = [m.select(*by, "_b", "_t", F.lit(0).alias("_q"), none, *values) for m in (begin, end, carried)]
    ask = asked(origins, width)
    if by:
        ask = ask.join(p.select(*by, F.explode(F.array_distinct(F.array("_first", "_b"))).alias("_b")).distinct(), "_b")
    rows = moves[0].unionByName(moves[1]).unionByName(moves[2]).unionByName(ask.select(*by, "_b", "_t", "_q", "origin_us", *(F.lit(0).cast("long").alias(v) for v in values)))
    w = Window.partitionBy(*by, "_b").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("origin_us", *by, *(F.sum(v).over(w).alias(v) for v in values)).where("origin_us is not null")


def pieces_of(events: DataFrame, width: int, time: str = "us", known: Column | None = None) -> DataFrame:
    """events with _s, _e: from when until when each lies in the time before an origin."""
    e = events.where(F.col(time).isNotNull()).withColumns({"_s": F.col(time) if known is None else F.greatest(F.col(time), known), "_e": F.col(time) + width})
    return e if known is None else e.where(known.isNotNull())


def merged(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _s, _e: pieces of each key that cover the same time without overlap, so that a key counts once."""
    w = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(*keys, F.greatest("_s", F.max("_e").over(w)).alias("_s"), "_e").where("_s < _e")


def latest_before(events: DataFrame, origins: DataFrame, width: int, value: Column, order: list[str], time: str = "us") -> DataFrame:
    """origin_us, value: of the last event in the time before each origin; origins without one are left out."""
    e = events.where(F.col(time).isNotNull()).select(_bucket(time, width).alias("_b"), F.col(time).alias("_t"), F.struct(*order, F.col(time).alias("_at"), value.alias("_value")).alias("_v"))
    carried = e.groupBy("_b").agg(F.max("_v").alias("_v")).select((F.col("_b") + 1).alias("_b"), ((F.col("_b") + 1) * width).alias("_t"), "_v")
    none = F.lit(None).cast(e.schema["_v"].dataType).alias("_v")
    rows = e.unionByName(carried).select("_b", "_t", F.lit(0).alias("_q"), F.lit(None).cast("long").alias("origin_us"), "_v").unionByName(asked(origins, width).select("_b", "_t", "_q", "origin_us", none))
    w = Window.partitionBy("_b").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.select("origin_us", F.max("_v").over(w).alias("_v")).where(F.col("origin_us").isNotNull() & (F.col("_v._at") > F.col("origin_us") - width))
    return last.select("origin_us", F.col("_v._value").alias("value"))
