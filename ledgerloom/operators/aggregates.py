"""Usage aggregations (A operators): every one is a partial aggregate before its shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES, complete_categories, context_utilization
from .filters import dimension

SUMS = (*CATEGORIES, "total")


def sums(columns=SUMS) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in columns]


def with_role(events: DataFrame, edges: DataFrame) -> DataFrame:
    """A session is a subagent's if it is a child in any edge; Spark broadcasts the children only when they are few."""
    children = edges.select(F.col("child").alias("session_id")).distinct().withColumn("_sub", F.lit(True))
    return events.join(children, "session_id", "left").withColumn("role", F.when(F.col("_sub"), "Subagent").otherwise("Root")).drop("_sub")


def usage_history(events: DataFrame, edges: DataFrame, context: DataFrame, unit: str = "hour") -> DataFrame:
    """A1: per time bucket the sums, the split by role, distinct sessions, and compactions."""
    e = with_role(events.where("quality = 'Valid'"), edges).withColumn("bucket", F.date_trunc(unit, "at").cast("timestamp_ntz"))
    of = lambda role: F.sum(F.when(F.col("role") == role, F.col("total")).otherwise(0)).cast("long")
    used = e.groupBy("bucket").agg(*sums(), of("Root").alias("root_tokens"), of("Subagent").alias("subagent_tokens"), F.count_distinct("session_id").alias("sessions"))
    marks = context.where("compaction").groupBy(F.date_trunc(unit, "at").cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("compactions"))
    return used.join(marks, "bucket", "full").fillna(0)


def meter_movement(quota: DataFrame, unit: str = "hour") -> DataFrame:
    """A1's meter part: positive moves per bucket and kind, only where a kind has one stream in the bucket."""
    w = Window.partitionBy("account", "kind", "resets_us").orderBy("us", "observation_id")
    moves = quota.withColumn("move", F.col("used") - F.lag("used").over(w)).withColumn("bucket", F.date_trunc(unit, "at").cast("timestamp_ntz"))
    g = moves.groupBy("bucket", "kind").agg(F.count_distinct("account").alias("streams"), F.sum(F.greatest("move", F.lit(0.0))).alias("moved"))
    return g.select("bucket", "kind", "streams", F.when(F.col("streams") == 1, F.coalesce("moved", F.lit(0.0))).alias("moved"))


def usage_by_dimension(events: DataFrame, dim: str, most: int | None = 20) -> DataFrame:
    """A2: totals by label, largest first, ties by label."""
    g = events.groupBy(dimension(F.col(dim).cast("string")).alias("label")).agg(F.sum("total").cast("long").alias("total"), F.count_distinct("session_id").alias("sessions"))
    return g if most is None else g.orderBy(F.desc("total"), "label").limit(most)


def usage_heatmap(events: DataFrame) -> DataFrame:
    """A3: weekday (0 is Sunday) by hour, with how many distinct hours were active."""
    return events.groupBy((F.dayofweek("at") - 1).alias("weekday"), F.hour("at").alias("hour")).agg(F.sum("total").cast("long").alias("total"), F.count_distinct(F.date_trunc("hour", "at")).alias("active_hours"))


def daily_report(events: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """A4: sums by UTC day; a day without events has no row."""
    e = events.where("quality = 'Valid'").withColumn("day", F.to_date("at"))
    if first:
        e = e.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        e = e.where(F.col("day") <= F.lit(last).cast("date"))
    return e.groupBy("day").agg(*sums(), F.count(F.lit(1)).alias("events"))


def model_usage(events: DataFrame) -> DataFrame:
    """A5: by model; first and last time only if all rows have a valid one, quality Mixed if there are several."""
    sure = F.bool_and(F.col("quality") == "Valid")
    return events.groupBy("model").agg(
        *sums(), F.when(sure, F.min("us")).alias("first_us"), F.when(sure, F.max("us")).alias("last_us"),
        F.when(F.count_distinct("quality") > 1, "Mixed").otherwise(F.min("quality")).alias("quality"),
    ).where("total > 0")


def hourly_usage(events: DataFrame) -> DataFrame:
    """By UTC hour; empty hours go."""
    return events.where("quality = 'Valid'").groupBy(F.date_trunc("hour", "at").cast("timestamp_ntz").alias("bucket")).agg(*sums()).where("total > 0")


def token_coverage(events: DataFrame) -> DataFrame:
    """How much of the ledger has a verified time and a model."""
    t = lambda c: F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0)).cast("long")
    ok, named = F.col("quality") == "Valid", F.nullif(F.trim("model"), F.lit("")).isNotNull()
    return events.agg(F.count_if(ok).alias("verified"), F.count_if(~ok).alias("unverified"), t(ok).alias("verified_tokens"), t(~ok).alias("unverified_tokens"), F.count_if(~named).alias("unnamed"), t(~named).alias("unnamed_tokens"))


def session_overview(events: DataFrame, context: DataFrame, edges: DataFrame) -> DataFrame:
    """Per session tokens, events, compactions, peak context use and parent; each table is reduced before joining."""
    used = events.groupBy("session_id").agg(F.sum("total").cast("long").alias("total"), F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    ctx = context.groupBy("session_id").agg(F.count_if("compaction").alias("compactions"), F.max(context_utilization(F.col("input"), F.col("window"))).alias("peak_context"))
    parent = edges.groupBy(F.col("child").alias("session_id")).agg(F.min("parent").alias("parent"))
    return used.join(ctx, "session_id", "left").join(parent, "session_id", "left").fillna(0, ["compactions"])


def recent_session_tokens(events: DataFrame, start: int, end: int, ids: DataFrame | None = None) -> DataFrame:
    """Totals by session in a window, for the sessions of `ids` if given."""
    e = events.where((F.col("us") >= start) & (F.col("us") < end))
    e = e if ids is None else e.join(ids, "session_id", "left_semi")
    return e.groupBy("session_id").agg(F.sum("total").cast("long").alias("total"))


def observatory_summary(events: DataFrame, files: DataFrame) -> DataFrame:
    """A10: one row of overall counts."""
    return events.agg(F.count_distinct("session_id").alias("sessions"), F.sum("total").cast("long").alias("total")).join(files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")))


def storage_summary(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per file its size, number of records and largest record."""
    r = records.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.max("bytes").cast("long").alias("largest"))
    return files.join(r, "file", "left").fillna(0, ["records"])


def ledger_buckets(events: DataFrame, hourly: bool = True) -> DataFrame:
    """A14."""
    return events.groupBy(F.date_trunc("hour" if hourly else "day", "at").cast("timestamp_ntz").alias("bucket")).agg(*sums())


def ledger_groups(events: DataFrame, dims: list[str]) -> DataFrame:
    """Totals for each label of each dimension in one pass over grouping sets, and totals by token category."""
    names = {d: dimension(F.col(d).cast("string")) for d in dims}
    base = events.select(*(c.alias(d) for d, c in names.items()), *SUMS)
    base.createOrReplaceTempView("_ledger_groups")
    sets = ", ".join(f"({d})" for d in dims)
    which = " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims)
    label = f"coalesce({', '.join(dims)})" if len(dims) > 1 else dims[0]
    by_label = events.sparkSession.sql(f"SELECT CASE {which} END AS dimension, {label} AS label, CAST(sum(total) AS BIGINT) AS total FROM _ledger_groups GROUP BY GROUPING SETS ({sets})")
    stack = ", ".join(f"'{c}', {c}" for c in CATEGORIES)
    kinds = events.agg(*sums(CATEGORIES)).selectExpr("'category' AS dimension", f"stack({len(CATEGORIES)}, {stack}) AS (label, total)")
    return by_label.unionByName(kinds)


def joint_workload(events: DataFrame, most: int = 256) -> DataFrame:
    """Tokens of each (model, effort) by category; the first `most` cells by name stay, the rest is one overflow row."""
    cells = events.groupBy("model", "effort").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in CATEGORIES))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_first("model"), F.asc_nulls_first("effort")))  # one row per cell, not per event
    placed = cells.withColumn("_over", rank > most)
    return placed.groupBy(F.when(~F.col("_over"), F.col("model")).alias("model"), F.when(~F.col("_over"), F.col("effort")).alias("effort"), F.col("_over").alias("overflow")).agg(*(F.sum(c).cast("long").alias(c) for c in CATEGORIES))


def combine_workloads(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """A weighted sum of joint workloads."""
    scaled = [p.select("model", "effort", "overflow", *(F.bround(F.col(c) * w, 6).alias(c) for c in CATEGORIES)) for p, w in parts]
    return reduce(DataFrame.unionByName, scaled).groupBy("model", "effort", "overflow").agg(*(F.sum(c).alias(c) for c in CATEGORIES))


def account_inventory(quota: DataFrame, most: int) -> DataFrame:
    """What is known of each account, the most read first."""
    g = quota.groupBy("provider", "profile", "source", "account").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("readings"))
    more = g.orderBy(F.desc("readings"), "account").limit(most + 1)
    return more.withColumn("truncated", F.lit(more.count() > most)).orderBy(F.desc("readings"), "account").limit(most)


def repeat_fingerprints(rows: DataFrame, columns: list[str], file: str, amount: str) -> DataFrame:
    """Rows that stand alike in several files, and what counting them again would add."""
    g = rows.groupBy(*columns).agg(F.count_distinct(file).alias("files"), F.count(F.lit(1)).alias("copies"), F.max(amount).alias("amount")).where("files > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("amount") * (F.col("copies") - 1)), F.lit(0)).cast("long").alias("extra"))


def response_repeats(responses: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Responses seen again, with the same counters or with others."""
    g = responses.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*values)).alias("kinds")).where("n > 1")
    return g.agg(F.count_if(F.expr("kinds = 1")).alias("repeated"), F.count_if(F.expr("kinds > 1")).alias("conflicting"))


def response_coverage(responses: DataFrame) -> DataFrame:
    """A26."""
    return responses.agg(F.count(F.lit(1)).alias("responses"), F.count_if(complete_categories()).alias("complete"), F.count_if(F.col("parent_id").isNotNull()).alias("with_lineage"), F.count_if(F.col("us").isNull()).alias("untimed"))


def evaluation_coverage(events: DataFrame) -> DataFrame:
    """Token mass with labels, and how much was collected late or at an unknown time."""
    t = lambda c: F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0)).cast("long")
    return events.agg(t(F.col("model").isNotNull()).alias("with_model"), t(F.col("effort").isNotNull()).alias("with_effort"), t(F.col("captured_us") > F.col("us")).alias("late"), t(F.col("captured_us").isNull()).alias("unknown_collection"), F.sum("total").cast("long").alias("total"))


def flag_counts(rows: DataFrame, keys: list[str], flags: str = "flags") -> DataFrame:
    """Rows of each key that carry a flag."""
    return rows.select(*keys, F.explode(F.array_distinct(flags)).alias("flag")).groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("rows"))


def reason_counts(decisions: DataFrame) -> DataFrame:
    """A29."""
    return decisions.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.count_if("eligible").alias("eligible"))


def event_inventory(records: DataFrame, kind: str, fields: dict[str, Column]) -> DataFrame:
    """Per class of records their number, time range and how many have each field."""
    return records.groupBy(kind).agg(F.count(F.lit(1)).alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), *(F.count_if(c.isNotNull()).alias(f"has_{n}") for n, c in fields.items()))


def rotate_candidates(events: DataFrame, fetched: DataFrame, k: int, pool: int) -> DataFrame:
    """Of the most recent sessions, those whose evidence was fetched longest ago."""
    recent = events.groupBy("session_id").agg(F.max("us").alias("last_us")).orderBy(F.desc("last_us"), "session_id").limit(pool)
    seen = fetched.groupBy("session_id").agg(F.max("fetched_us").alias("fetched_us"))
    return recent.join(seen, "session_id", "left").orderBy(F.asc_nulls_first("fetched_us"), F.desc("last_us"), "session_id").limit(k)


def share_rows(events: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Each label's share of its key's tokens; unknown labels count in the whole alone."""
    cells = events.groupBy(*keys, field).agg(F.sum(F.greatest("total", F.lit(0))).cast("long").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(*keys))
    return cells.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).where(F.nullif(F.trim(field), F.lit("")).isNotNull())


def share_map(events: DataFrame, keys: list[str], field: str) -> DataFrame:
    """A32 as a map column."""
    rows = share_rows(events, keys, field)
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "share")))).alias("shares"))


def model_catalog(models: DataFrame, events: DataFrame) -> DataFrame:
    """Known and observed model names with their use."""
    used = events.groupBy("model").agg(F.sum("total").cast("long").alias("total"))
    return models.select("model", F.lit(True).alias("known")).join(used, "model", "full").select("model", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("total", F.lit(0)).alias("total"))
