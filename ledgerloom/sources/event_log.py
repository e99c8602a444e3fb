"""Line-JSON event logs (S1 to S10): scanning, ownership, carried context, and the facts in them.

Records: file, ordinal, value (the line), type, nested, payload (JSON text), bytes.  A line that is no JSON
object becomes a record of type `unknown`; nothing fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
STRICT_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?([zZ]|[+-]\d{2}:\d{2})$"
#: Epoch numbers above this are milliseconds.
MILLIS_ABOVE = 100_000_000_000


def parse_lines(lines: DataFrame, *passed: str) -> DataFrame:
    """file, ordinal, value -> records, with the columns that are passed on."""
    kind = F.get_json_object("value", "$.type")
    ok = F.get_json_object("value", "$").startswith("{")
    return lines.select(
        *passed, "file", "ordinal", "value",
        F.when(ok & kind.isNotNull(), kind).otherwise("unknown").alias("type"),
        F.substring(F.coalesce(F.get_json_object("value", "$.payload.type"), F.when(ok & kind.isNotNull(), kind), F.lit("unknown")), 1, 80).alias("nested"),
        F.get_json_object("value", "$.payload").alias("payload"), F.octet_length("value").alias("bytes"),
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of all log files; ordinal follows the place in the file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("ordinal"), "value")
    return parse_lines(raw.where(F.trim("value") != ""))


def owner_of(file: Column) -> Column:
    """The last UUID of a file's name; in the form with a suffix after an underscore, the one before it."""
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    desktop = F.regexp_extract(name, rf"^rollout-\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}-\d{{2}}-\d{{2}}-({UUID})_{UUID}$", 1)
    found = F.regexp_extract_all(name, F.lit(f"({UUID})"), F.lit(1))
    return F.coalesce(F.nullif(desktop, F.lit("")), F.when(F.size(found) > 0, F.element_at(found, -1)))


def assign_owner(records: DataFrame) -> DataFrame:
    """Rows from the owner's own session_meta on; earlier ones are copied history of a parent and go."""
    r = records.withColumn("owner", F.lower(owner_of(F.col("file"))))
    meta = F.lower(F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.session_id")))
    first = F.min(F.when((F.col("type") == "session_meta") & (meta == F.col("owner")), F.col("ordinal"))).over(Window.partitionBy("file"))
    return r.withColumn("_first", first).where(F.col("ordinal") >= F.col("_first")).drop("_first")


def inherited_rows(records: DataFrame) -> DataFrame:
    """How many rows of each file precede its owner's session_meta."""
    kept = assign_owner(records).groupBy("file").agg(F.count(F.lit(1)).alias("own"))
    return records.groupBy("file").agg(F.count(F.lit(1)).alias("all")).join(kept, "file", "left").select("file", F.coalesce("own", F.lit(0)).alias("own"), (F.col("all") - F.coalesce("own", F.lit(0))).alias("inherited"))


def carry_turn_context(records: DataFrame) -> DataFrame:
    """S3: model and window carry forward; the effort is set anew by each turn context, to NULL as well."""
    w = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.col("type") == "turn_context") | (F.col("nested") == "turn_context")
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    effort = F.coalesce(get("effort"), get("reasoning_effort"))
    return records.withColumns({
        "model": F.last(F.when(turn, get("model")), ignorenulls=True).over(w),
        "effort": F.last(F.when(turn, F.struct(effort.alias("e"))), ignorenulls=True).over(w)["e"],
        "context_window": F.last(F.when(turn, get("model_context_window").cast("long")), ignorenulls=True).over(w),
    })


def parse_source_time(value: Column, root: str = "$.timestamp", payload: str = "$.payload.timestamp") -> tuple[Column, Column]:
    """(microseconds, Valid / Missing / Malformed); the root's field wins, then the payload's."""
    def one(text: Column) -> Column:
        number = F.when(text.rlike(r"^-?\d{1,18}$"), text.cast("long"))
        return F.coalesce(
            F.when(text.rlike(STRICT_TIME), F.unix_micros(F.try_to_timestamp(text))),
            F.when(number > MILLIS_ABOVE, number * 1000).otherwise(number * 1_000_000),
        )

    a, b = F.get_json_object(value, root), F.get_json_object(value, payload)
    us = F.coalesce(one(a), one(b))
    return us, F.when(us.isNotNull(), "Valid").when(a.isNotNull() | b.isNotNull(), "Malformed").otherwise("Missing")


def with_time(records: DataFrame) -> DataFrame:
    us, quality = parse_source_time(F.col("value"))
    return records.withColumn("us", us).withColumn("quality", quality)


#: The counters' names in a log, and ours.
USAGE = {"input": "input_tokens", "cached": "cached_input_tokens", "cache_write": "cache_write_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens", "total": "total_tokens"}
_COUNTS = f"struct<{', '.join(f'{c}: string' for c in USAGE.values())}>"


def _usage(path: str) -> Column:
    each = F.col(f"_info.info.{path}")
    return F.when(each.isNotNull(), F.struct(*(each[c].try_cast("long").alias(n) for n, c in USAGE.items())))


def extract_token_observations(records: DataFrame) -> DataFrame:
    """Nullable total and last counters of token_count events."""
    r = with_time(records.where("nested = 'token_count'")).withColumn("_info", F.from_json("payload", f"info struct<total_token_usage: {_COUNTS}, last_token_usage: {_COUNTS}>"))  # all counters by one parse
    keep = [c for c in ("owner", "model", "effort") if c in records.columns]
    return r.select("file", "ordinal", *keep, "us", "quality", _usage("total_token_usage").alias("total"), _usage("last_token_usage").alias("last"))


def window_kind(minutes: Column) -> Column:
    return F.when(minutes == 300, "FiveHour").when(minutes == 10080, "Weekly").otherwise("Unknown")


def extract_rate_limits(records: DataFrame) -> DataFrame:
    """One reading for each limit lane."""
    kind = "map<string,struct<used_percent:double,window_minutes:int,resets_at:bigint>>"
    r = with_time(records).withColumn("lanes", F.from_json(F.get_json_object("payload", "$.rate_limits"), kind)).where("lanes is not null")
    lanes = r.select("file", "ordinal", "us", F.explode("lanes").alias("lane", "v")).where("v is not null")
    return lanes.select("file", "ordinal", "us", "lane", window_kind(F.col("v.window_minutes")).alias("kind"), F.col("v.used_percent").alias("used"), F.col("v.window_minutes").alias("window_minutes"), (F.col("v.resets_at") * 1_000_000).alias("resets_us"))


def extract_context(records: DataFrame) -> DataFrame:
    """Context-window samples and compaction marks."""
    r = with_time(records.where("nested in ('token_count', 'compacted') or type = 'compacted'"))
    window = F.coalesce(F.get_json_object("payload", "$.info.model_context_window").try_cast("long"), F.col("context_window") if "context_window" in records.columns else F.lit(None).cast("long"))
    return r.select("file", "ordinal", "us", F.get_json_object("payload", "$.info.last_token_usage.input_tokens").try_cast("long").alias("input"), window.alias("window"), ((F.col("type") == "compacted") | (F.col("nested") == "compacted")).alias("compaction"))


def extract_turns(records: DataFrame) -> DataFrame:
    """Turn and session metadata."""
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    source = get("source")
    kind = F.when(F.col("type") == "session_meta", F.when(source.startswith("{"), F.element_at(F.json_object_keys(source), 1)).otherwise(source))
    r = with_time(records.where("type in ('session_meta', 'turn_context') or nested in ('task_started', 'task_complete', 'turn_aborted', 'thread_settings_applied')"))
    return r.select(
        "file", "ordinal", "us", "nested", get("turn_id").alias("turn_id"), get("parent_thread_id").alias("parent_id"), kind.alias("source_kind"),
        get("duration_ms").try_cast("long").alias("duration_ms"), get("time_to_first_token_ms").try_cast("long").alias("first_token_ms"),
        F.when(F.col("nested") == "thread_settings_applied", F.coalesce(get("service_tier"), get("settings.service_tier"))).alias("service_tier"),
    )


def extract_responses(records: DataFrame) -> DataFrame:
    """Counters of single responses with their lineage; only cache writes may default to 0, and that is told."""
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    n = lambda p: get(f"usage.{p}").try_cast("long")
    r = with_time(records.where("type = 'token_usage_record'"))
    write = n("cache_write_input_tokens")
    return r.select(
        "file", "ordinal", "us", get("response_id").alias("response_id"), get("thread_id").alias("thread_id"), get("parent_response_id").alias("parent_id"),
        n("input_tokens").alias("input"), n("cached_input_tokens").alias("cached"), F.coalesce(write, F.lit(0)).alias("cache_write"), write.isNull().alias("cache_write_defaulted"),
        n("output_tokens").alias("output"), n("reasoning_output_tokens").alias("reasoning"), n("total_tokens").alias("total"),
    )


def extract_lifecycle(records: DataFrame) -> DataFrame:
    """Sessions with parent, first and last time, and the state that their last event shows."""
    r = with_time(records)
    state = F.when(F.col("nested") == "task_complete", "Completed").when(F.col("nested").isin("turn_aborted", "error"), "Failed").when(F.col("type").isin("session_meta", "turn_context", "event_msg"), "Running")
    return r.groupBy("owner").agg(
        F.first(F.get_json_object("payload", "$.parent_thread_id"), ignorenulls=True).alias("parent"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.coalesce(F.max_by(state, F.when(state.isNotNull(), F.col("ordinal"))), F.lit("Unknown")).alias("state"), F.count(F.lit(1)).alias("events"),
    )
