"""Projections, filters and row policies (P, L and U operators)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import authority, like_escaped, valid_percent

UNKNOWN = "(unknown)"
#: The source whose readings belong to the default limit, and that limit's name.
DEFAULT_SOURCE, DEFAULT_LIMIT = "codex-app-server:codex", "codex"
COHORT = ("provider", "profile", "kind", "source", "account", "limit_id", "plan", "session", "window_minutes")


def select_ledger(df: DataFrame, start: int | None = None, end: int | None = None, time: str = "us", **exact) -> DataFrame:
    """Rows in [start, end) that equal every given column value."""
    if start is not None:
        df = df.where(F.col(time) >= start)
    if end is not None:
        df = df.where(F.col(time) < end)
    for name, value in exact.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def dimension(c: Column | str) -> Column:
    """An empty or missing label is a label of its own."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN))


def usage_filter(df: DataFrame, start: int | None = None, end: int | None = None, **exact) -> DataFrame:
    """select_ledger on rows whose event time is valid, with labels made explicit."""
    df = select_ledger(df.where(F.col("quality") == "Valid"), start, end)
    for name, value in exact.items():
        if value is not None:
            df = df.where(dimension(name) == value)
    return df


def search_logs(df: DataFrame, levels: list[str] | None = None, text: str | None = None, ids: dict | None = None, start=None, end=None, level: str = "level", message: str = "message", time: str = "ts") -> DataFrame:
    """Levels without case, an escaped substring, exact ids and a half-open time range; a filter on a column that
    the table lacks matches nothing."""
    def has(c: str) -> bool:
        return c in df.columns

    tests = []
    if levels:
        tests.append(F.lower(level).isin([x.lower() for x in levels]) if has(level) else F.lit(False))
    if text:
        tests.append(F.col(message).ilike(like_escaped(text)) if has(message) else F.lit(False))
    for c, v in (ids or {}).items():
        tests.append(F.col(c) == v if has(c) else F.lit(False))
    if start is not None:
        tests.append(F.col(time) >= start if has(time) else F.lit(False))
    if end is not None:
        tests.append(F.col(time) < end if has(time) else F.lit(False))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search_rows(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows any of whose columns contains the text, without case."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in columns)))


def trace_key(tables: dict[str, DataFrame], column: str, value, most: int | None = None) -> DataFrame:
    """P5: rows of every table that has the column and the value in it, as (table_name, row)."""
    found = [t.where(F.col(column) == value).select(F.lit(name).alias("table_name"), F.to_json(F.struct(*t.columns)).alias("row")) for name, t in sorted(tables.items()) if column in t.columns]
    out = reduce(DataFrame.unionByName, found)
    return out if most is None else out.orderBy("table_name", "row").limit(most)


def cohort_key() -> Column:
    """The nine columns that keep streams apart; NULL is a value.  A provider's own reading belongs to its default
    limit, and only embedded readings are told apart by session."""
    auth = authority(F.col("source"))
    limit = F.coalesce("limit_id", F.when((F.col("source") == DEFAULT_SOURCE) | (F.col("observation_id").isNotNull() & (auth == "EmbeddedObservation")), DEFAULT_LIMIT))
    session = F.when(auth == "EmbeddedObservation", F.col("session"))
    return F.struct(*((limit if c == "limit_id" else session if c == "session" else F.col(c)).alias(c) for c in COHORT))


def available_rows(df: DataFrame, mode: str = "reconstructed") -> DataFrame:
    """Readings by event time, or only as they were collected; the measured time is kept."""
    df = df.withColumn("measured_us", F.col("us"))
    if mode == "reconstructed":
        return df
    known = df.where(F.col("collected_us").isNotNull() | (authority(F.col("source")) == "ProviderAuthoritative"))
    return known.withColumn("us", F.greatest("us", F.coalesce("collected_us", "us")))


def opaque_limits(df: DataFrame, salt: str, ids: list[str]) -> DataFrame:
    """P20: limits that may be shared: ids by a keyed hash, invalid percents NULL, no account."""
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids))
    return df.select(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 24).alias("id"), "kind", F.when(valid_percent(F.col("used")), F.col("used")).alias("used"), "window_minutes", "resets_us")


def ordered_page(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """L1: a page in an order that ties cannot change."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """L2 and L4: the first n rows of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """L3."""
    return df.orderBy(*order).limit(k)


def bounded(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """At most k rows, each telling whether more were there."""
    more = df.orderBy(*order).limit(k + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return more.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > k).where(F.col("_n") <= k).drop("_n")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key, as evenly spread over its order as whole positions allow."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    picked = (F.col("_n") <= most) | (F.floor(F.col("_i") * most / F.col("_n")) != F.floor((F.col("_i") - 1) * most / F.col("_n")))
    return numbered.where(picked).drop("_i", "_n")


def sessions_of(*facts: DataFrame, key: str = "session_id") -> DataFrame:
    """The distinct sessions of several fact tables."""
    return reduce(DataFrame.union, (f.select(key) for f in facts)).distinct()


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of two tables and which of them has each."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def labelled_union(groups: dict[str, DataFrame]) -> DataFrame:
    """U4: unlike groups as one result, each row with its group's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("dimension", F.lit(name)) for name, df in groups.items()))
