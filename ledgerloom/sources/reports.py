"""Provider reports, price catalogues and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .event_log import window_kind
from .shared import kept

DAILY = "struct<units:string,start_date:string,end_date:string,data:array<struct<date:string,credits:decimal(38,6),tokens:bigint,surfaces:map<string,double>>>>"


def read_daily_reports(df: DataFrame, body: str = "body", ids: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """One row per day; a report with repeated days, negative amounts or days outside its range is Invalid."""
    r = df.select(*ids, F.from_json(F.col(body), DAILY).alias("r")).select(*ids, "r.units", "r.start_date", "r.end_date", F.explode_outer("r.data").alias("d"))
    r = r.select(*ids, "units", "start_date", "end_date", F.to_date("d.date").alias("day"), "d.credits", "d.tokens", "d.surfaces")
    w = Window.partitionBy(*ids)
    percent = F.aggregate(F.map_values("surfaces"), F.lit(0.0), lambda a, x: a + x)
    bad = (
        F.col("day").isNull() | (F.col("credits") < 0) | (F.col("tokens") < 0) | F.exists(F.map_values(F.coalesce("surfaces", F.create_map().cast("map<string,double>"))), lambda x: x < 0)
        | (F.col("day") < F.to_date("start_date")) | (F.col("day") > F.to_date("end_date"))
    )
    r = r.withColumn("percent", percent).withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*ids, "day")))
    return r.withColumn("state", F.when(F.bool_or(F.col("_bad") | (F.col("_same") > 1)).over(w), "Invalid").otherwise("Available")).drop("_bad", "_same", "surfaces")


USAGE = "struct<status:string,lifetime_tokens:bigint,threads:array<struct<id:string,model:string,effort:string,tokens:bigint>>>"


def read_usage_reports(df: DataFrame, body: str = "body", ids: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Threads of account reports, each with the report's state.

    A report may come in several rows (pages) of the same ids; its state is that of all its pages together: unavailable, unsupported or
    invalid if one of them is, a conflict if a thread stands twice in any of them.  So no row need hold a whole report.
    """
    r = df.select(*ids, F.from_json(F.col(body), USAGE).alias("r")).select(*ids, "r.status", "r.lifetime_tokens", F.explode_outer("r.threads").alias("t"))
    r = r.select(*ids, "status", "lifetime_tokens", F.col("t").isNotNull().alias("_thread"), F.col("t.id").alias("thread_id"), F.col("t.model").alias("model"), F.col("t.effort").alias("effort"), F.col("t.tokens").alias("tokens"))
    one = r.groupBy(*ids, "thread_id", "model", "effort").agg(
        F.count_if("_thread").alias("_n"), F.bool_or(F.coalesce(F.col("tokens") < 0, F.lit(False))).alias("_negative"), F.max("lifetime_tokens").alias("_lifetime"),
        F.bool_or(F.col("status").isNull()).alias("_invalid"), F.bool_or(F.col("status") == "unavailable").alias("_unavailable"), F.bool_or(~F.col("status").isin("ok", "unavailable")).alias("_unsupported"),
    )
    g = one.groupBy(*ids).agg(F.sum("_n").alias("_threads"), F.max("_n").alias("_most"), F.max("_lifetime").alias("lifetime_tokens"), *(F.bool_or(c).alias(c) for c in ("_negative", "_invalid", "_unavailable", "_unsupported")))
    state = (
        F.when(F.col("_invalid"), "Invalid").when(F.col("_unavailable"), "Unavailable").when(F.col("_unsupported"), "Unsupported")
        .when(F.col("_negative"), "Invalid").when(F.col("_most") > 1, "Conflict").when(F.col("_threads") == 0, "Empty").otherwise("Available")
    )
    g = kept(g.select(*ids, state.alias("state"), "lifetime_tokens", "_threads"), "usage-reports")
    threads = r.where("_thread").select(*ids, "thread_id", "model", "effort", "tokens")
    same = lambda a, b: reduce(Column.__and__, (a[i].eqNullSafe(b[i]) for i in ids))
    found = threads.join(g, same(threads, g)).select(*(threads[i] for i in ids), "state", "lifetime_tokens", "thread_id", "model", "effort", "tokens")
    none = lambda c: F.lit(None).cast(threads.schema[c].dataType).alias(c)
    return found.unionByName(g.where("_threads = 0").select(*ids, "state", "lifetime_tokens", *map(none, ("thread_id", "model", "effort", "tokens"))))


PLAN = "struct<periods:array<struct<id:string,start:string,end:string,breakdowns:array<struct<dimension:string,items:array<struct<label:string,percent:double>>>>>>,tasks:array<struct<thread:string,percent:double>>>"


def read_plan_reports(df: DataFrame, body: str = "body", ids: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Historical plan periods, one row per breakdown item."""
    r = df.select(*ids, F.explode_outer(F.from_json(F.col(body), PLAN)["periods"]).alias("p"))
    r = r.select(*ids, F.col("p.id").alias("period"), F.to_date("p.start").alias("from_day"), F.to_date("p.end").alias("to_day"), F.explode_outer("p.breakdowns").alias("b"))
    return r.select(*ids, "period", "from_day", "to_day", F.col("b.dimension").alias("dimension"), F.explode_outer("b.items").alias("i")).select(*ids, "period", "from_day", "to_day", "dimension", "i.label", "i.percent")


def read_task_reports(df: DataFrame, body: str = "body", ids: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Each task's percentage."""
    return df.select(*ids, F.explode(F.from_json(F.col(body), PLAN)["tasks"]).alias("t")).select(*ids, F.col("t.thread").alias("thread"), F.col("t.percent").alias("percent"))


RATES = "model string, category string, unit string, currency string, price decimal(18,6), from_day date, to_day date"


def validate_prices(rates: DataFrame) -> DataFrame:
    """Rates with `problem`: wrong unit or currency, negative price, empty or overlapping interval; NULL if sound."""
    w = Window.partitionBy("model", "category").orderBy(F.asc_nulls_first("from_day"))
    before = F.lag(F.coalesce("to_day", F.lit("9999-12-31").cast("date"))).over(w)
    problem = (
        F.when(F.col("unit") != "million-tokens", "unit").when(F.col("currency") != "USD", "currency").when(F.col("price") < 0, "negative")
        .when(F.col("from_day") >= F.col("to_day"), "empty-interval").when(before > F.coalesce("from_day", F.lit("0001-01-01").cast("date")), "overlap")
    )
    return rates.withColumn("problem", problem)


def read_price_catalog(spark: SparkSession, path: str) -> DataFrame:
    return validate_prices(spark.read.schema(RATES).json(path))


def read_external_usage(df: DataFrame) -> DataFrame:
    """Model-hour totals of another tool; where its output holds the reasoning as well, that is taken out.

    df: model, hour_us, input, cache_read, cache_write, output, reasoning, total.
    """
    base = F.col("input") + F.col("cache_read") + F.col("cache_write")
    folded = (base + F.col("output") == F.col("total")) & (F.col("reasoning") > 0) & (F.col("output") >= F.col("reasoning"))
    return df.withColumn("output_held_reasoning", folded).withColumn("output", F.when(folded, F.col("output") - F.col("reasoning")).otherwise(F.col("output")))


def write_daily_json(days: DataFrame, path: str, schema_tag: str = "daily-tokens/v1") -> None:
    """Aggregates only, each line with the schema's tag and what it covers."""
    cover = F.struct(F.col("day").alias("from"), F.date_add("day", 1).alias("before"), F.col("events").alias("events"))
    days.select(F.lit(schema_tag).alias("schema"), "day", F.struct(*(c for c in days.columns if c not in ("day", "events"))).alias("tokens"), cover.alias("coverage")).write.json(path)


#: Columns whose content or place must not leave the machine.
CONTENT = ("text", "message", "body", "payload", "html", "prompt", "value", "title")
PLACE = ("path", "file", "cwd", "url", "repository")


def sanitized_export(df: DataFrame, salt: str) -> DataFrame:
    """Content columns become NULL, places keyed hashes; the rest stays."""
    def clean(c: str) -> Column:
        if c.lower() in CONTENT:
            return F.lit(None).cast("string").alias(c)
        if c.lower() in PLACE:
            return F.substring(F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256), 1, 24).alias(c)
        return F.col(c)

    return df.select(*(clean(c) for c in df.columns))


LIMITS = "map<string,struct<plan:string,reached:string,credits:double,spend_control:boolean,primary:struct<used_percent:double,window_minutes:int>,secondary:struct<used_percent:double,window_minutes:int>>>"


def read_limit_metadata(df: DataFrame, body: str = "body", ids: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """A row for each named limit."""
    r = df.select(*ids, F.explode(F.from_json(F.get_json_object(F.col(body), "$.limits"), LIMITS)).alias("limit_id", "v"))
    return r.select(*ids, "limit_id", "v.plan", "v.reached", "v.credits", "v.spend_control", window_kind(F.col("v.primary.window_minutes")).alias("primary_kind"), F.col("v.primary.used_percent").alias("primary_used"), window_kind(F.col("v.secondary.window_minutes")).alias("secondary_kind"), F.col("v.secondary.used_percent").alias("secondary_used"))
