"""Queries of sources and sinks: logs, reports, catalogues, merges, file sequences, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..sources import adapters as D
from ..sources import event_log as L
from ..sources import merge as G
from ..sources import reports as R
from ..sources import samples as X
from ..sources.adapters import with_sql
from ..sources.shared import kept
from ..streaming import streams as T
from . import queries_meter  # noqa: F401  (its SQL is used below)
from .registry import ORACLE, query

OWNER = "concat_ws('-', substr(md5(CAST(user_id AS VARCHAR)), 1, 8), substr(md5(CAST(user_id AS VARCHAR)), 9, 4), substr(md5(CAST(user_id AS VARCHAR)), 13, 4), substr(md5(CAST(user_id AS VARCHAR)), 17, 4), substr(md5(CAST(user_id AS VARCHAR)), 21, 12))"


def _records(spark, sf):
    return L.assign_owner(L.parse_lines(X.log_lines(spark, sf)))


@query(with_sql("ev", "SELECT nested, count(*) AS rows FROM (SELECT 'token_count' AS nested FROM ev UNION ALL SELECT 'turn_context' FROM ev WHERE k % 5 = 0 UNION ALL SELECT 'compacted' FROM ev WHERE k = 7 UNION ALL SELECT 'token_usage_record' FROM ev WHERE k % 4 = 2 UNION ALL SELECT 'task_complete' FROM ev WHERE k % 10 = 3 UNION ALL SELECT 'unknown' FROM ev WHERE k % 50 = 1 UNION ALL SELECT 'session_meta' FROM (SELECT DISTINCT user_id FROM ev) UNION ALL SELECT unnest(['session_meta', 'task_complete']) FROM (SELECT DISTINCT user_id FROM ev WHERE user_id % 3 = 1)) GROUP BY 1"))
def s1_read_event_log(spark, sf):
    path = X.scratch(spark, "logs")
    X.log_lines(spark, sf).select("value").write.text(path)
    return L.read_event_log(spark, path).groupBy("nested").agg(F.count(F.lit(1)).alias("rows"))


@query(with_sql("ev", f"SELECT user_id, {OWNER} AS owner, CAST(CASE WHEN user_id % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS inherited FROM (SELECT DISTINCT user_id FROM ev)").replace("SELECT user_id, ", "SELECT ", 1))
def s2_assign_owner(spark, sf):
    return L.inherited_rows(L.parse_lines(X.log_lines(spark, sf))).select(L.owner_of(F.col("file")).alias("owner"), "inherited")


@query(with_sql("ev", f", c AS (SELECT user_id, event_id, k, last_value(CASE WHEN k % 5 = 0 THEN event_type END IGNORE NULLS) OVER w AS model, last_value(CASE WHEN k % 5 = 0 THEN event_id END IGNORE NULLS) OVER w AS src FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT {OWNER} AS owner, c.event_id * 16 + 4 AS ordinal, c.model, CASE WHEN s.k % 10 = 0 THEN CASE s.k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS effort FROM c LEFT JOIN (SELECT event_id, k FROM ev) s ON s.event_id = c.src"))
def s3_carry_turn_context(spark, sf):
    return L.carry_turn_context(_records(spark, sf)).where("nested = 'token_count'").select("owner", "ordinal", "model", "effort")


@query(with_sql("ev", "SELECT event_id * 16 + 4 AS ordinal, CASE WHEN k % 33 = 0 THEN NULL ELSE us END AS us, CASE WHEN k % 33 = 0 THEN 'Malformed' ELSE 'Valid' END AS quality FROM ev"))
def s4_parse_source_time(spark, sf):
    return L.with_time(_records(spark, sf).where("nested = 'token_count'")).select("ordinal", "us", "quality")


@query(with_sql("ev", ", e AS (SELECT *, sum(CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ep FROM ev), o AS (SELECT *, CAST(sum(inc) OVER (PARTITION BY user_id, ep ORDER BY event_id) AS BIGINT) AS t FROM e) SELECT event_id * 16 + 4 AS ordinal, t AS total, t*80//100 AS input, CASE WHEN k % 4 = 1 THEN inc END AS last_total FROM o"))
def s5_extract_token_observations(spark, sf):
    return L.extract_token_observations(_records(spark, sf)).select("ordinal", F.col("total.total").alias("total"), F.col("total.input").alias("input"), F.col("last.total").alias("last_total"))


@query(with_sql("ev", "SELECT event_id * 16 + 4 AS ordinal, lane, kind, CAST(k AS DOUBLE) AS used, us // 1000000 * 1000000 AS resets_us FROM ev, (VALUES ('primary', 'FiveHour'), ('secondary', 'Weekly')) v(lane, kind) WHERE k % 10 = 0"))
def s6_extract_rate_limits(spark, sf):
    return L.extract_rate_limits(_records(spark, sf)).select("ordinal", "lane", "kind", "used", "resets_us")


@query(with_sql("ev", "SELECT event_id * 16 + 4 AS ordinal, CASE WHEN k % 4 = 1 THEN inc*80//100 END AS input, 25840::BIGINT AS window, false AS compaction FROM ev UNION ALL SELECT event_id * 16 + 5, NULL, NULL, true FROM ev WHERE k = 7"))
def s7_extract_context(spark, sf):
    c = L.extract_context(_records(spark, sf))
    return c.select("ordinal", "input", "window", "compaction")


@query(with_sql("ev", "SELECT nested, count(*) AS rows, CAST(coalesce(sum(d), 0) AS BIGINT) AS duration FROM (SELECT 'turn_context' AS nested, NULL AS d FROM ev WHERE k % 5 = 0 UNION ALL SELECT 'task_complete', k * 10 FROM ev WHERE k % 10 = 3 UNION ALL SELECT 'session_meta', NULL FROM (SELECT DISTINCT user_id FROM ev)) GROUP BY 1"))
def s8_extract_turns(spark, sf):
    return L.extract_turns(_records(spark, sf)).groupBy("nested").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("duration"))


@query(with_sql("ev", "SELECT event_id * 16 + 6 AS ordinal, 'r' || event_id AS response_id, k % 8 <> 2 AS cache_write_defaulted, k % 8 = 2 AS has_parent FROM ev WHERE k % 4 = 2"))
def s9_extract_responses(spark, sf):
    return L.extract_responses(_records(spark, sf)).select("ordinal", "response_id", "cache_write_defaulted", F.col("parent_id").isNotNull().alias("has_parent"))


@query(with_sql("ev", f"SELECT {OWNER} AS owner, CASE WHEN user_id % 3 = 1 THEN {OWNER.replace('user_id', 'user_id - 1')} END AS parent, min(us) AS first_us FROM ev GROUP BY user_id"))
def s10_extract_lifecycle(spark, sf):
    return L.extract_lifecycle(_records(spark, sf)).select("owner", "parent", "first_us")


@query(with_sql("led server", ", r AS (SELECT *, strftime(day, '%Y-%m') AS report_id FROM server UNION ALL SELECT *, strftime(day, '%Y-%m') FROM server WHERE day(day) = 1 AND month(day) % 2 = 0), d AS (SELECT report_id, bool_or(n > 1) AS dup FROM (SELECT report_id, day, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT report_id, day, CAST(server_total AS DOUBLE) AS credits, 3.5::DOUBLE AS percent, CASE WHEN dup THEN 'Invalid' ELSE 'Available' END AS state FROM r JOIN d USING (report_id)"))
def s11_read_daily_reports(spark, sf):
    return R.read_daily_reports(X.daily_bodies(spark, sf)).select("report_id", "day", F.col("credits").cast("double").alias("credits"), "percent", "state")


@query(with_sql("ev tok", "SELECT model AS report_id, 'Available' AS state, CAST(session_id AS VARCHAR) AS thread_id, effort, CAST(sum(total) AS BIGINT) AS tokens FROM tok WHERE model <> 'error' GROUP BY 1, session_id, effort UNION ALL SELECT 'error', 'Unavailable', NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM tok WHERE model = 'error')"))
def s12_read_usage_reports(spark, sf):
    return R.read_usage_reports(X.usage_bodies(spark, sf)).select("report_id", "state", "thread_id", "effort", "tokens")


@query(with_sql("led", "SELECT strftime(day, '%Y') AS report_id, strftime(day, '%Y-%m') AS period, model AS label, CAST(sum(total) AS DOUBLE) AS percent FROM led GROUP BY 1, 2, 3"))
def s13_read_plan_reports(spark, sf):
    return R.read_plan_reports(X.plan_bodies(spark, sf)).select("report_id", "period", "label", "percent")


@query(with_sql("led", "SELECT DISTINCT strftime(day, '%Y') AS report_id, t.thread, t.percent FROM led, (VALUES ('t1', 40.0::DOUBLE), ('t2', 60.0::DOUBLE)) t(thread, percent)"))
def s13_read_task_reports(spark, sf):
    return R.read_task_reports(X.plan_bodies(spark, sf))


@query("SELECT model, from_day, CASE WHEN model = 'AF' AND from_day IS NOT NULL THEN 'overlap' END AS problem FROM (SELECT DISTINCT l_returnflag || l_linestatus AS model FROM lineitem), (VALUES (NULL::DATE), (DATE '1995-07-01')) v(from_day)")
def s14_read_price_catalog(spark, sf):
    path = X.scratch(spark, "prices")
    r = D.price_rates(spark, sf).select("model", F.lit("total").alias("category"), F.lit("million-tokens").alias("unit"), F.lit("USD").alias("currency"), "price", "from_day", F.when((F.col("model") == "AF") & F.col("from_day").isNull(), F.lit("1995-08-01").cast("date")).otherwise(F.col("to_day")).alias("to_day"))
    r.write.json(path)
    return R.read_price_catalog(spark, path).select("model", "from_day", "problem")


@query(with_sql("ev tok", "SELECT event_id, k % 2 = 0 AND reasoning > 0 AS output_held_reasoning, CASE WHEN k % 2 = 0 THEN output ELSE output + reasoning END AS output FROM tok"))
def s15_read_external_usage(spark, sf):
    t = D.token_events(spark, sf).withColumn("input", F.col("uncached"))
    base = F.col("uncached") + F.col("cache_read") + F.col("cache_write") + F.col("output") + F.col("reasoning")
    t = t.withColumn("total", F.when(F.col("k") % 2 == 0, base).otherwise(base + F.col("reasoning") + 1)).withColumn("output", F.col("output") + F.col("reasoning"))
    return R.read_external_usage(t).select("event_id", "output_held_reasoning", "output")


@query(with_sql("ev tok", "SELECT event_id, CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 'filled' WHEN k % 2 = 0 THEN NULL ELSE model END AS model, CASE WHEN k % 5 = 0 AND k % 4 <> 0 AND false THEN 0 ELSE total END AS total FROM tok WHERE k % 3 <> 0 UNION ALL SELECT event_id, 'filled', total + 1 FROM tok WHERE k % 3 = 0 AND k % 4 <> 0"))
def s16_upsert_events(spark, sf):
    t = D.token_events(spark, sf).select("event_id", F.when(F.col("k") % 2 != 0, F.col("model")).alias("model"), "total", "k")
    batch = t.where("k % 4 <> 0").select("event_id", F.lit("filled").alias("model"), (F.col("total") + 1).alias("total"))
    return G.upsert_events(t.where("k % 3 <> 0").drop("k"), batch.union(batch), "event_id", ["model"])


@query("WITH f AS (SELECT doc_id, doc_id = max(doc_id) OVER (PARTITION BY source || '/' || CAST(doc_id % 50 AS VARCHAR)) AS active FROM documents) SELECT active, count(*) AS labels, CAST(sum(quality) AS BIGINT) AS good FROM labels JOIN f USING (doc_id) GROUP BY 1")
def s17_supersede_generation(spark, sf):
    d = D.read(spark, sf, "documents")
    files = G.active_generation(d.select(F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("path"), "doc_id"), "path", "doc_id", "doc_id")
    live, retired = G.supersede_generation(files, D.read(spark, sf, "labels"), "doc_id")
    g = lambda df, a: df.groupBy(F.lit(a).alias("active")).agg(F.count(F.lit(1)).alias("labels"), F.sum("quality").cast("long").alias("good"))
    return g(live, True).unionByName(g(retired, False))


@query(with_sql("ev tok", "SELECT 'daily-tokens/v1' AS schema, CAST(CAST(at AS DATE) AS VARCHAR) AS day, CAST(sum(total) AS BIGINT) AS total, count(*) AS events FROM tok WHERE quality = 'Valid' GROUP BY 1, 2"))
def s18_write_daily_json(spark, sf):
    path = X.scratch(spark, "daily")
    R.write_daily_json(A.daily_report(D.token_events(spark, sf)), path)
    back = spark.read.schema("schema string, day string, tokens struct<total:long>, coverage struct<events:long>").json(path)
    return back.select("schema", "day", F.col("tokens.total").alias("total"), F.col("coverage.events").alias("events"))


@query("SELECT page_id, substr(sha256('pepper' || url), 1, 24) AS url, CAST(NULL AS VARCHAR) AS html FROM pages")
def s19_sanitized_export(spark, sf):
    return R.sanitized_export(D.read(spark, sf, "pages"), "pepper")


@query(with_sql("ev quota", ", l AS (SELECT account, used FROM quota QUALIFY row_number() OVER (PARTITION BY account ORDER BY us DESC, observation_id DESC) = 1) SELECT account AS report_id, limit_id, 'pro' AS plan, CASE WHEN used >= 80 THEN 'primary' END AS reached, 'FiveHour' AS primary_kind, 'Weekly' AS secondary_kind, used AS primary_used FROM l, (VALUES ('codex'), ('other')) v(limit_id)"))
def s20_read_limit_metadata(spark, sf):
    return R.read_limit_metadata(X.limit_bodies(spark, sf)).select("report_id", "limit_id", "plan", "reached", "primary_kind", "secondary_kind", "primary_used")


@query(with_sql("ev tok", ", r AS (SELECT model AS account, session_id, us // 86400000000 AS day FROM tok GROUP BY 1, 2, 3), l AS (SELECT *, rank() OVER (PARTITION BY account ORDER BY day DESC) AS n FROM r), t AS (SELECT session_id, CAST(sum(total) AS BIGINT) AS local_total, bool_and(quality = 'Valid') AS verified FROM tok WHERE session_id % 5 <> 0 GROUP BY 1) SELECT account, l.session_id, day, local_total, verified, local_total IS NOT NULL AS owned FROM l LEFT JOIN t USING (session_id) WHERE n = 1"))
def j16_task_accounting(spark, sf):
    t = D.token_events(spark, sf)
    reports = t.select(F.col("model").alias("account"), "session_id", F.floor(F.col("us") / D.DAY_US).alias("day")).distinct()
    return J.task_accounting(reports, t.where("session_id % 5 <> 0"), "account", "day", "session_id")


PERIODS = ", p AS (SELECT CAST(date_trunc('month', day) AS DATE) AS m, CAST(sum(server_total) AS BIGINT) AS reported FROM server GROUP BY 1), l AS (SELECT CAST(date_trunc('month', day) AS DATE) AS m, CAST(sum(total) AS BIGINT) AS t, count(DISTINCT day) AS d FROM led GROUP BY 1), pc AS (SELECT CAST(date_trunc('month', day) AS DATE) AS m, sum(CASE WHEN month(day) % 5 = 0 AND day(day) = 1 THEN server_total + 5 ELSE server_total END) AS s FROM server GROUP BY 1)"
NOW = "epoch_us(TIMESTAMP '1998-06-15')"


@query(with_sql("led server", PERIODS + f""" SELECT strftime(p.m, '%Y-%m') AS period, reported, l.t AS local_total, array_to_string(list_filter([
    CASE WHEN epoch_us(CAST(CAST(p.m + INTERVAL 1 MONTH AS DATE) AS TIMESTAMP)) > {NOW} OR month(p.m) % 6 = 0 THEN 'provisional' END, CASE WHEN coalesce(d, 0) < date_diff('day', p.m, CAST(p.m + INTERVAL 1 MONTH AS DATE)) OR month(p.m) % 6 = 0 THEN 'incomplete' END,
    CASE WHEN month(p.m) % 7 = 0 THEN 'freshness-unknown' END, CASE WHEN month(p.m) % 7 <> 0 AND {NOW} - (epoch_us(CAST(CAST(p.m + INTERVAL 1 MONTH AS DATE) AS TIMESTAMP)) + 3600000000) > 7200000000 THEN 'delayed' END,
    CASE WHEN month(p.m) % 4 = 0 THEN 'revised' END, CASE WHEN month(p.m) % 4 <> 0 AND month(p.m) % 2 = 0 THEN 'unchanged' END, CASE WHEN month(p.m) = 3 THEN 'approximate' END, CASE WHEN l.t IS NULL THEN 'unmatched' END, CASE WHEN l.t <> reported THEN 'different' END,
    CASE WHEN abs(pc.s - reported) > 1 THEN 'conflicting-partition' END], lambda x: x IS NOT NULL), ',') AS states FROM p LEFT JOIN l ON p.m = l.m LEFT JOIN pc ON p.m = pc.m"""))
def j17_reconcile_periods(spark, sf):
    ledger = kept(D.order_ledger(spark, sf).groupBy("day").agg(F.sum("total").cast("long").alias("total")), "ledger-days")  # several sides rest on it
    daily = D.server_daily(spark, sf, ledger)
    p = daily.groupBy(F.trunc("day", "month").alias("from_day")).agg(F.sum("server_total").cast("long").alias("reported"))
    month, end = F.month("from_day"), F.add_months("from_day", 1)
    p = p.select(F.date_format("from_day", "yyyy-MM").alias("period"), "from_day", end.alias("to_day"), "reported", (month % 6 != 0).alias("complete"), F.when(month % 7 != 0, F.unix_date(end) * F.lit(86_400_000_000) + 3_600_000_000).alias("as_of_us"), (month == 3).alias("approximate"))
    captures = p.select("period", F.when(month % 2 == 0, 2).otherwise(1).alias("captures"), F.when(month % 4 == 0, 1).otherwise(0).alias("revisions"))
    off = F.when((F.month("day") % 5 == 0) & (F.dayofmonth("day") == 1), 5).otherwise(0)
    parts = daily.select(F.date_format("day", "yyyy-MM").alias("period"), F.lit("day").alias("dimension"), F.col("day").cast("string").alias("part"), (F.col("server_total") + off).alias("amount"))
    return J.reconcile_periods(p, ledger, captures, parts, 897_868_800_000_000).select("period", "reported", "local_total", "states")


SEQ = ", s AS (SELECT doc_id AS f, unnest(range(len(string_split(text, chr(10))))) AS pos, md5(unnest(string_split(text, chr(10)))) AS h FROM documents), d AS (SELECT DISTINCT f, h FROM s), fo AS (SELECT x.f AS a, y.f AS b FROM d x JOIN d y ON x.h = y.h AND x.f < y.f), pr AS (SELECT a, b, count(*) AS shared FROM fo GROUP BY 1, 2), n AS (SELECT f, count(*) AS n FROM s GROUP BY 1), df AS (SELECT a, b, min(x.pos) AS diff FROM pr JOIN s x ON x.f = a JOIN s y ON y.f = b AND y.pos = x.pos WHERE x.h <> y.h GROUP BY 1, 2)"


@query("WITH one AS (SELECT 1)" + SEQ + " SELECT pr.a, pr.b, shared, coalesce(diff, least(na.n, nb.n)) AS shared_prefix, CASE WHEN coalesce(diff, least(na.n, nb.n)) = na.n AND coalesce(diff, least(na.n, nb.n)) = nb.n THEN 'Equal' WHEN coalesce(diff, least(na.n, nb.n)) = least(na.n, nb.n) THEN 'Prefix' WHEN coalesce(diff, least(na.n, nb.n)) > 0 THEN 'Divergent' ELSE 'Overlap' END AS relation FROM pr JOIN n na ON na.f = pr.a JOIN n nb ON nb.f = pr.b LEFT JOIN df ON df.a = pr.a AND df.b = pr.b")
def j19_fingerprint_pairs(spark, sf):
    d = D.read(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("fingerprint", F.md5("line")).select("file", F.col("pos").cast("long").alias("pos"), "fingerprint")
    return J.fingerprint_pairs(s)


def drained(spark, stream, tag: str, schema) -> object:
    """Run a stream over all that is there into Parquet and read the result."""
    out = X.scratch(spark, tag)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", X.scratch(spark, tag + "-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query(with_sql("ev", "SELECT nested, count(*) AS rows FROM (SELECT 'token_count' AS nested FROM ev UNION ALL SELECT 'turn_context' FROM ev WHERE k % 5 = 0 UNION ALL SELECT 'compacted' FROM ev WHERE k = 7) GROUP BY 1"))
def t1_stream_events(spark, sf):
    path = X.scratch(spark, "chunks")
    X.log_lines(spark, sf).select("value").write.text(path)
    s = T.stream_events(spark, path).where("nested in ('token_count', 'turn_context', 'compacted')")
    return drained(spark, s, "events", s.schema).groupBy("nested").agg(F.count(F.lit(1)).alias("rows"))


@query(ORACLE["w1_reduce_counters"])
def t2_stream_counters(spark, sf):
    path = X.scratch(spark, "observations")
    o = D.token_observations(spark, sf)
    o.write.parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = T.stream_counters(spark.readStream.schema(o.schema).parquet(path))
        return drained(spark, s, "reduced", s.schema).drop("us").drop("us")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query(with_sql("ev", "SELECT event_id, user_id FROM ev"))
def t3_stream_dedup(spark, sf):
    path = X.scratch(spark, "twice")
    e = D.events(spark, sf).select("event_id", "user_id", F.timestamp_micros("us").alias("time"))
    e.union(e).write.parquet(path)
    s = T.stream_dedup(spark.readStream.schema(e.schema).parquet(path), "event_id", "time", "40 days").select("event_id", "user_id")
    return drained(spark, s, "once", s.schema)
