"""Queries of the ledger: filters, usage aggregates, dimension and interval joins, prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import pricing as V
from ..sources import adapters as D
from ..sources.adapters import with_sql
from .registry import query

DAY0 = 1_704_067_200_000_000  # 2024-01-01
HOUR = 3_600_000_000
SUM6 = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in A.SUMS)


@query(with_sql("ev tok", f"SELECT event_id, session_id, model, total FROM tok WHERE us >= {DAY0 + 24 * HOUR} AND us < {DAY0 + 96 * HOUR} AND model = 'click'"))
def p1_select_ledger(spark, sf):
    return P.select_ledger(D.token_events(spark, sf), DAY0 + 24 * HOUR, DAY0 + 96 * HOUR, model="click").select("event_id", "session_id", "model", "total")


@query(with_sql("ev tok", f"SELECT event_id, model, total FROM tok WHERE quality = 'Valid' AND us < {DAY0 + 96 * HOUR} AND effort = 'low'"))
def p2_usage_filter(spark, sf):
    return P.usage_filter(D.token_events(spark, sf), None, DAY0 + 96 * HOUR, effort="low").select("event_id", "model", "total")


@query("SELECT doc_id, source FROM documents WHERE lower(lang) IN ('en','fr') AND text ILIKE '%100\\%%' ESCAPE '\\' OR (lower(lang) IN ('en','fr') AND text ILIKE '%tion th%' ESCAPE '\\')")
def p3_search_logs(spark, sf):
    docs = D.read(spark, sf, "documents")
    find = lambda t: P.search_logs(docs, levels=["EN", "fr"], text=t, level="lang", message="text", time="doc_id").select("doc_id", "source")
    return find("100%").union(find("tion th")).distinct()


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '0001') OR contains(lower(c_mktsegment), 'auto')")
def p4_search_sessions(spark, sf):
    c = D.read(spark, sf, "customer")
    return P.search_rows(c, "0001", ["c_name", "c_mktsegment"]).union(P.search_rows(c, "AUTO", ["c_name", "c_mktsegment"])).select("c_custkey", "c_name", "c_mktsegment").distinct()


@query("SELECT 'documents' AS table_name, count(*) AS rows FROM documents WHERE doc_id = 7 HAVING count(*) > 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id = 7 HAVING count(*) > 0")
def p5_trace_key(spark, sf):
    t = {n: D.read(spark, sf, n) for n in ("documents", "labels", "pages")}
    return P.trace_key(t, "doc_id", 7).groupBy("table_name").agg(F.count(F.lit(1)).alias("rows"))


@query(with_sql("ev tok", "SELECT event_id, uncached, cache_read, cache_write, output, reasoning, total - (uncached+cache_read+cache_write+output+reasoning) AS gap, total = uncached+cache_read+cache_write+output+reasoning AS complete, round(cache_read*100.0/(uncached+cache_read+cache_write), 6) AS cache_percent FROM tok"))
def p6_p7_p8_p9_categories(spark, sf):
    e = D.events(spark, sf)
    c = D.counters(F.col("inc"))
    cats = S.disjoint_categories(c["input"], c["cached"], c["cache_write"], c["output"], c["reasoning"])
    t = e.select("event_id", F.col("inc").alias("total"), *(v.alias(n) for n, v in cats.items()))
    return t.select("event_id", *S.CATEGORIES, S.integrity().alias("gap"), S.complete_categories().alias("complete"), F.round(S.input_share("cache_read"), 6).alias("cache_percent"))


@query(with_sql("ev", "SELECT event_id, round(least(100.0, inc*100.0/25840), 6) AS utilization FROM ev"))
def p10_context_utilization(spark, sf):
    return D.context_observations(spark, sf).select("event_id", F.round(S.context_utilization(F.col("input"), F.col("window")), 6).alias("utilization"))


@query(with_sql("ev quota", "SELECT observation_id, used, round((us - (resets_us - 604800000000)) * 100.0 / 604800000000, 6) AS elapsed, round(used - (us - (resets_us - 604800000000)) * 100.0 / 604800000000, 6) AS excess, 'ProviderAuthoritative' AS authority FROM quota"))
def p11_p12_even_burn(spark, sf):
    q = D.quota_snapshots(spark, sf)
    e = S.elapsed_percent(F.col("us"), F.col("resets_us"), F.col("window_minutes"))
    return q.select("observation_id", "used", F.round(e, 6).alias("elapsed"), F.round(F.col("used") - e, 6).alias("excess"), S.authority(F.col("source")).alias("authority"))


@query(with_sql("ev quota", "SELECT account, count(*) AS readings, count(DISTINCT account) AS cohorts FROM quota GROUP BY account"))
def p13_cohort_key(spark, sf):
    q = D.quota_snapshots(spark, sf).withColumn("cohort", P.cohort_key())
    return q.groupBy("account").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("cohort").alias("cohorts"))


@query(with_sql("ev quota", "SELECT observation_id, greatest(us, collected_us) AS us, us AS measured_us FROM quota"))
def p14_available_rows(spark, sf):
    return P.available_rows(D.quota_snapshots(spark, sf), "collected").select("observation_id", "us", "measured_us")


@query(with_sql("ev turns", "SELECT session_id, turn, CASE WHEN ended_us IS NOT NULL THEN 'Completed' WHEN (SELECT max(us) FROM ev) - last_us <= 7200000000 THEN 'RecentlyWorking' ELSE 'StaleInProgress' END AS state FROM turns"))
def p15_activity_state(spark, sf):
    t = D.turns(spark, sf)
    now = t.agg(F.max("last_us").alias("now_us"))
    j = t.join(F.broadcast(now))  # one row
    return j.select("session_id", "turn", S.activity_state(F.when(F.col("ended_us").isNotNull(), "completed").otherwise("in_progress"), F.col("last_us"), F.col("now_us"), 2 * HOUR).alias("state"))


@query(with_sql("ev tok", "SELECT date_trunc('day', at) AS bucket, CAST(sum(total) AS BIGINT) AS total FROM tok GROUP BY 1"))
def p16_bucket_granularity(spark, sf):
    t = D.token_events(spark, sf)
    r = t.agg(F.min("us").alias("a"), F.max("us").alias("z")).first()
    return t.groupBy(F.date_trunc(S.bucket_unit(r.z - r.a, 100), "at").cast("timestamp_ntz").alias("bucket")).agg(F.sum("total").cast("long").alias("total"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1') AS url FROM pages")
def p17_sanitize_remote_url(spark, sf):
    return D.read(spark, sf, "pages").select("page_id", S.sanitize_remote_url(F.col("url")).alias("url"))


@query(with_sql("ev quota", """, p AS (SELECT observation_id, account, used, lag(used) OVER (PARTITION BY account, resets_us ORDER BY us, observation_id) AS before FROM quota)
    SELECT observation_id, greatest(0, greatest(0, used - 0.5) - least(100, before + 0.5)) AS lower, greatest(0, least(100, used + 0.5) - greatest(0, before - 0.5)) AS upper,
    CASE WHEN 1.0 < greatest(0, greatest(0, used - 0.5) - least(100, before + 0.5)) THEN greatest(0, greatest(0, used - 0.5) - least(100, before + 0.5)) - 1.0
    WHEN 1.0 > greatest(0, least(100, used + 0.5) - greatest(0, before - 0.5)) THEN 1.0 - greatest(0, least(100, used + 0.5) - greatest(0, before - 0.5)) ELSE 0.0 END AS loss FROM p WHERE used IS NOT NULL AND before IS NOT NULL"""))
def p18_p19_envelope(spark, sf):
    w = Window.partitionBy("account", "resets_us").orderBy("us", "observation_id")
    q = D.quota_snapshots(spark, sf).withColumn("before", F.lag("used").over(w)).where("used is not null and before is not null")
    low, high = S.measurement_envelope(F.col("before"), F.col("used"), F.lit(True))
    return q.select("observation_id", low.alias("lower"), high.alias("upper"), S.interval_loss(F.lit(1.0), low, high).alias("loss"))


@query(with_sql("ev quota", "SELECT substr(sha256('pepper' || account || chr(31) || CAST(observation_id AS VARCHAR)), 1, 24) AS id, kind, used, window_minutes, resets_us FROM quota"))
def p20_opaque_limits(spark, sf):
    return P.opaque_limits(D.quota_snapshots(spark, sf), "pepper", ["account", "observation_id"])


@query(with_sql("ev tok", "SELECT event_id, total FROM tok ORDER BY us DESC, event_id DESC LIMIT 50 OFFSET 100"))
def l1_ordered_page(spark, sf):
    return P.ordered_page(D.token_events(spark, sf), [F.desc("us"), F.desc("event_id")], 50, 100).select("event_id", "total")


@query(with_sql("ev quota", "SELECT account, observation_id, used FROM quota QUALIFY row_number() OVER (PARTITION BY account ORDER BY us DESC, observation_id DESC) <= 512"))
def l2_latest_per_key(spark, sf):
    return P.latest_per_key(D.quota_snapshots(spark, sf), ["account"], [F.desc("us"), F.desc("observation_id")], 512).select("account", "observation_id", "used")


@query(with_sql("ev tok", "SELECT session_id, CAST(sum(total) AS BIGINT) AS total FROM tok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def l3_top_k(spark, sf):
    g = D.token_events(spark, sf).groupBy("session_id").agg(F.sum("total").cast("long").alias("total"))
    return P.top_k(g, [F.desc("total"), F.col("session_id")], 10)


@query(with_sql("ev turns", "SELECT session_id, turn, started_us FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY started_us) <= 3"))
def l4_first_rows(spark, sf):
    return P.latest_per_key(D.turns(spark, sf), ["session_id"], [F.col("started_us")], 3).select("session_id", "turn", "started_us")


@query(with_sql("ev quota", ", g AS (SELECT account, count(*) AS readings FROM quota GROUP BY 1) SELECT account, readings, (SELECT count(*) FROM g) > 3 AS truncated FROM g ORDER BY readings DESC, account LIMIT 3"))
def l5_bounded(spark, sf):
    g = D.quota_snapshots(spark, sf).groupBy("account").agg(F.count(F.lit(1)).alias("readings"))
    return P.bounded(g, [F.desc("readings"), F.col("account")], 3)


@query(with_sql("ev quota", ", n AS (SELECT account, observation_id, row_number() OVER (PARTITION BY account ORDER BY us, observation_id) - 1 AS i, count(*) OVER (PARTITION BY account) AS n FROM quota) SELECT account, observation_id FROM n WHERE n <= 32 OR floor(i * 32.0 / n) <> floor((i - 1) * 32.0 / n)"))
def l6_evenly_spaced(spark, sf):
    return P.evenly_spaced(D.quota_snapshots(spark, sf), ["account"], [F.col("us"), F.col("observation_id")], 32).select("account", "observation_id")


@query(with_sql("ev", "SELECT DISTINCT user_id AS session_id FROM ev UNION SELECT DISTINCT user_id FROM ev WHERE k = 7"))
def u1_sessions_of(spark, sf):
    return P.sessions_of(D.token_events(spark, sf), D.context_observations(spark, sf).where("compaction"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_left, b.doc_id IS NOT NULL AS in_right FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def u2_key_union(spark, sf):
    return P.key_union(D.read(spark, sf, "documents"), D.read(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3_set_operations(spark, sf):
    return D.read(spark, sf, "documents").select("doc_id").exceptAll(D.read(spark, sf, "labels").select("doc_id"))


@query("SELECT 'lang' AS dimension, lang AS label, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def u4_labelled_union(spark, sf):
    d = D.read(spark, sf, "documents")
    g = lambda c: d.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return P.labelled_union({"lang": g("lang"), "source": g("source")}).select("dimension", "label", "rows")


HISTORY = f""", roles AS (SELECT t.*, CASE WHEN e.child IS NOT NULL THEN 'Subagent' ELSE 'Root' END AS role FROM tok t LEFT JOIN edges e ON t.session_id = e.child WHERE quality = 'Valid'),
    u AS (SELECT date_trunc('hour', at) AS bucket, {SUM6}, CAST(sum(CASE WHEN role = 'Root' THEN total ELSE 0 END) AS BIGINT) AS root_tokens, CAST(sum(CASE WHEN role = 'Subagent' THEN total ELSE 0 END) AS BIGINT) AS subagent_tokens, count(DISTINCT session_id) AS sessions FROM roles GROUP BY 1),
    c AS (SELECT date_trunc('hour', at) AS bucket, count(*) AS compactions FROM ev WHERE k = 7 GROUP BY 1)
    SELECT coalesce(u.bucket, c.bucket) AS bucket, {", ".join(f"coalesce({x}, 0) AS {x}" for x in (*A.SUMS, "root_tokens", "subagent_tokens", "sessions", "compactions"))} FROM u FULL JOIN c ON u.bucket = c.bucket"""


@query(with_sql("ev tok edges", HISTORY))
def usage_history(spark, sf):
    """The flagship query."""
    return A.usage_history(D.token_events(spark, sf), D.session_edges(spark, sf), D.context_observations(spark, sf))


@query(with_sql("ev quota", """, m AS (SELECT *, used - lag(used) OVER (PARTITION BY account, kind, resets_us ORDER BY us, observation_id) AS move FROM quota)
    SELECT date_trunc('hour', at) AS bucket, kind, count(DISTINCT account) AS streams, CASE WHEN count(DISTINCT account) = 1 THEN coalesce(sum(greatest(move, 0.0)), 0.0) END AS moved FROM m GROUP BY 1, 2"""))
def a1_meter_movement(spark, sf):
    return A.meter_movement(D.quota_snapshots(spark, sf))


@query(with_sql("led", "SELECT repository AS label, CAST(sum(total) AS BIGINT) AS total, count(DISTINCT session_id) AS sessions FROM led GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def a2_usage_by_dimension(spark, sf):
    return A.usage_by_dimension(D.order_ledger(spark, sf), "repository")


@query(with_sql("ev tok", "SELECT CAST(dayofweek(at) AS INT) AS weekday, CAST(hour(at) AS INT) AS hour, CAST(sum(total) AS BIGINT) AS total, count(DISTINCT date_trunc('hour', at)) AS active_hours FROM tok GROUP BY 1, 2"))
def a3_usage_heatmap(spark, sf):
    return A.usage_heatmap(D.token_events(spark, sf))


@query(with_sql("ev tok", f"SELECT CAST(at AS DATE) AS day, {SUM6}, count(*) AS events FROM tok WHERE quality = 'Valid' AND CAST(at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1"))
def a4_daily_report(spark, sf):
    return A.daily_report(D.token_events(spark, sf), "2024-01-03", "2024-01-20")


@query(with_sql("ev tok", f"SELECT model, {SUM6}, CASE WHEN bool_and(quality = 'Valid') THEN min(us) END AS first_us, CASE WHEN bool_and(quality = 'Valid') THEN max(us) END AS last_us, CASE WHEN count(DISTINCT quality) > 1 THEN 'Mixed' ELSE min(quality) END AS quality FROM tok GROUP BY model HAVING sum(total) > 0"))
def a5_model_usage(spark, sf):
    return A.model_usage(D.token_events(spark, sf))


@query(with_sql("ev tok", f"SELECT date_trunc('hour', at) AS bucket, {SUM6} FROM tok WHERE quality = 'Valid' GROUP BY 1 HAVING sum(total) > 0"))
def a6_hourly_usage(spark, sf):
    return A.hourly_usage(D.token_events(spark, sf))


@query(with_sql("ev tok", "SELECT count(*) FILTER (quality = 'Valid') AS verified, count(*) FILTER (quality <> 'Valid') AS unverified, CAST(coalesce(sum(total) FILTER (quality = 'Valid'), 0) AS BIGINT) AS verified_tokens, CAST(coalesce(sum(total) FILTER (quality <> 'Valid'), 0) AS BIGINT) AS unverified_tokens, 0::BIGINT AS unnamed, 0::BIGINT AS unnamed_tokens FROM tok"))
def a7_token_coverage(spark, sf):
    return A.token_coverage(D.token_events(spark, sf))


@query(with_sql("ev tok edges", """, u AS (SELECT session_id, CAST(sum(total) AS BIGINT) AS total, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM tok GROUP BY 1),
    c AS (SELECT user_id AS session_id, count(*) FILTER (k = 7) AS compactions, round(max(least(100.0, inc*100.0/25840)), 6) AS peak_context FROM ev GROUP BY 1)
    SELECT u.*, coalesce(compactions, 0) AS compactions, peak_context, parent FROM u LEFT JOIN c USING (session_id) LEFT JOIN (SELECT child, min(parent) AS parent FROM edges GROUP BY child) p ON u.session_id = p.child"""))
def a8_session_overview(spark, sf):
    o = A.session_overview(D.token_events(spark, sf), D.context_observations(spark, sf), D.session_edges(spark, sf))
    return o.withColumn("peak_context", F.round("peak_context", 6))


@query(with_sql("ev tok edges", f"SELECT session_id, CAST(sum(total) AS BIGINT) AS total FROM tok WHERE us >= {DAY0 + 100 * HOUR} AND us < {DAY0 + 300 * HOUR} AND session_id IN (SELECT child FROM edges) GROUP BY 1"))
def a9_recent_session_tokens(spark, sf):
    return A.recent_session_tokens(D.token_events(spark, sf), DAY0 + 100 * HOUR, DAY0 + 300 * HOUR, D.session_edges(spark, sf).select(F.col("child").alias("session_id")))


def _files(spark, sf):
    d = D.read(spark, sf, "documents")
    return d.select(F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("doc_id").alias("file"), F.octet_length("text").cast("long").alias("bytes"))


def _records(spark, sf):
    d = D.read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("bytes", F.octet_length("line"))


@query(with_sql("ev tok", "SELECT (SELECT count(DISTINCT session_id) FROM tok) AS sessions, (SELECT CAST(sum(total) AS BIGINT) FROM tok) AS total, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes"))
def a10_observatory_summary(spark, sf):
    return A.observatory_summary(D.token_events(spark, sf), _files(spark, sf))


@query("SELECT source || '/' || CAST(doc_id % 50 AS VARCHAR) AS path, doc_id AS file, CAST(strlen(text) AS BIGINT) AS bytes, len(string_split(text, chr(10))) AS records, CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) AS BIGINT) AS largest FROM documents")
def a11_storage_summary(spark, sf):
    return A.storage_summary(_files(spark, sf), _records(spark, sf))


@query(with_sql("ev tok", f"SELECT date_trunc('day', at) AS bucket, {SUM6} FROM tok GROUP BY 1"))
def a14_ledger_buckets(spark, sf):
    return A.ledger_buckets(D.token_events(spark, sf), hourly=False)


@query(with_sql("ev tok", "SELECT 'model' AS dimension, model AS label, CAST(sum(total) AS BIGINT) AS total FROM tok GROUP BY model UNION ALL SELECT 'effort', effort, CAST(sum(total) AS BIGINT) FROM tok GROUP BY effort UNION ALL SELECT 'session_id', CAST(session_id AS VARCHAR), CAST(sum(total) AS BIGINT) FROM tok GROUP BY session_id UNION ALL " + " UNION ALL ".join(f"SELECT 'category', '{c}', CAST(sum({c}) AS BIGINT) FROM tok" for c in S.CATEGORIES)))
def a15_ledger_groups(spark, sf):
    return A.ledger_groups(D.token_events(spark, sf), ["model", "effort", "session_id"])


@query(with_sql("ev tok", ", c AS (SELECT model, effort, " + ", ".join(f"sum({x}) AS {x}" for x in S.CATEGORIES) + " FROM tok GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY model, effort) > 8 AS overflow FROM c) SELECT CASE WHEN NOT overflow THEN model END AS model, CASE WHEN NOT overflow THEN effort END AS effort, overflow, " + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in S.CATEGORIES) + " FROM r GROUP BY 1, 2, 3"))
def a16_joint_workload(spark, sf):
    return A.joint_workload(D.token_events(spark, sf), 8)


@query(with_sql("ev tok", "SELECT model, effort, false AS overflow, " + ", ".join(f"CAST(CAST(sum({x}) AS DOUBLE) * 1.5 AS DOUBLE) AS {x}" for x in S.CATEGORIES) + " FROM tok GROUP BY 1, 2"))
def a17_combine_workloads(spark, sf):
    w = A.joint_workload(D.token_events(spark, sf))
    return A.combine_workloads([(w, 1.0), (w, 0.5)])


def _category_prices(spark, sf):
    names = D.read(spark, sf, "events").select(F.col("event_type").alias("model")).distinct().where("model <> 'error'")
    cats = spark.createDataFrame([(c, (i + 1) * 0.25) for i, c in enumerate(S.CATEGORIES)], "category string, base double")
    j = names.crossJoin(F.broadcast(cats)).where("not (model = 'view' and category = 'cache_write')")
    return j.select("model", "category", (F.col("base") * F.ascii("model")).cast("decimal(18,6)").alias("price"))


PRICES = ", prices AS (SELECT model, category, CAST(base * ascii(model) AS DECIMAL(18,6)) AS price FROM (SELECT DISTINCT event_type AS model FROM events WHERE event_type <> 'error') CROSS JOIN (VALUES " + ", ".join(f"('{c}', {(i + 1) * 0.25})" for i, c in enumerate(S.CATEGORIES)) + ") v(category, base) WHERE NOT (model = 'view' AND category = 'cache_write')), cells AS (" + " UNION ALL ".join(f"SELECT event_id, model, '{c}' AS category, {c} AS tokens FROM tok WHERE {c} > 0" for c in S.CATEGORIES) + "), j AS (SELECT * FROM cells LEFT JOIN prices USING (model, category)), per AS (SELECT event_id, CAST(sum(tokens * price) AS DECIMAL(38,6)) AS w, coalesce(sum(tokens) FILTER (price IS NOT NULL), 0) AS p, coalesce(sum(tokens) FILTER (price IS NULL), 0) AS u FROM j GROUP BY 1)"


@query(with_sql("ev tok", PRICES + " SELECT CAST(sum(w) AS DOUBLE) AS weight, CAST(sum(p) AS BIGINT) AS priced_tokens, CAST(sum(u) AS BIGINT) AS unpriced_tokens, count(*) FILTER (u = 0) AS priced_events, count(*) FILTER (u > 0) AS unpriced_events FROM per"))
def a18_fixed_price_weight(spark, sf):
    return V.fixed_price_weight(D.token_events(spark, sf), _category_prices(spark, sf)).withColumn("weight", F.col("weight").cast("double"))


VALUED = """, over AS (SELECT 'AF' AS model, 1.25::DECIMAL(18,6) AS price), now AS (SELECT model, price FROM rates WHERE from_day IS NULL AND model <> 'NO'), j AS (SELECT led.*, coalesce(o.price, n.price) AS price, CASE WHEN o.price IS NOT NULL THEN 'override' WHEN n.price IS NOT NULL THEN 'primary' END AS price_source FROM led LEFT JOIN over o USING (model) LEFT JOIN now n ON led.model = n.model)"""


def _valued(spark, sf):
    over = spark.createDataFrame([("AF",)], "model string").withColumn("price", F.lit(1.25).cast("decimal(18,6)"))
    now = D.price_rates(spark, sf).where("from_day is null and model <> 'NO'").select("model", "price")
    return J.layered_lookup(D.order_ledger(spark, sf), [("override", over), ("primary", now)])


@query(with_sql("led rates", VALUED + " SELECT price_source, count(*) AS items, CAST(sum(total) AS BIGINT) AS total, CAST(sum(total * price) AS DOUBLE) AS amount FROM j GROUP BY 1"))
def j7_layered_lookup(spark, sf):
    return _valued(spark, sf).groupBy("price_source").agg(F.count(F.lit(1)).alias("items"), F.sum("total").cast("long").alias("total"), F.sum(F.col("total") * F.col("price")).cast("double").alias("amount"))


@query(with_sql("led rates", VALUED + """, g AS (SELECT price_source AS s, sum(total * price) / 1000000.0 AS amount, sum(total) AS t, sum(total) FILTER (price_source IS NULL) AS u FROM j GROUP BY 1),
    r AS (SELECT coalesce(s, '(none)') AS source, amount, t, coalesce(u, 0) AS u FROM g UNION ALL SELECT '(all)', sum(amount), sum(t), coalesce(sum(u), 0) FROM g)
    SELECT source, round(CAST(amount AS DOUBLE), 6) AS covered, CAST(t AS BIGINT) AS tokens, CAST(u AS BIGINT) AS unpriced, CASE WHEN u > 0 THEN 'Partial' ELSE 'Complete' END AS state, CASE WHEN u = 0 THEN round(CAST(amount AS DOUBLE), 6) END AS full_amount FROM r"""))
def a19_price_valuation(spark, sf):
    v = V.price_valuation(_valued(spark, sf))
    return v.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("covered", "full_amount")})


@query(with_sql("ev tok", PRICES + " SELECT round(CAST(sum(tokens * price) AS DOUBLE), 4) AS covered, true AS unsupported, CAST(NULL AS DOUBLE) AS score FROM j"))
def a20_j25_score_exact(spark, sf):
    cells = V.unpivot(D.token_events(spark, sf).select("event_id", "model", *S.CATEGORIES), ["event_id", "model"]).where("tokens > 0")
    return V.tt_score_exact(cells, _category_prices(spark, sf).withColumnRenamed("price", "weight"), 1e6, ["model"]).withColumn("covered", F.round(F.col("covered").cast("double"), 4))


@query(with_sql("ev tok", """, b AS (SELECT uncached, cache_read, CASE WHEN k % 6 = 0 THEN NULL ELSE cache_write END AS cache_write, CASE WHEN k % 6 = 0 THEN NULL ELSE output END AS output, reasoning, uncached+cache_read+cache_write+output+reasoning AS total FROM tok),
    r AS (SELECT uncached*1.0 + cache_read*0.25 + coalesce(cache_write*2.0, 0) + coalesce(output*4.0, 0) + reasoning*4.0 AS base, total - uncached - cache_read - reasoning AS rest, output IS NULL AS free FROM b)
    SELECT 'FiniteBounds' AS state, 0::BIGINT AS Inconsistent, 0::BIGINT AS Unbounded, count(*) FILTER (free AND rest > 0) AS FiniteBounds, count(*) FILTER (NOT (free AND rest > 0)) AS Exact,
    round(sum(base + CASE WHEN free AND rest > 0 THEN 2.0 * rest ELSE 0 END) / 1000000, 6) AS low, round(sum(base + CASE WHEN free AND rest > 0 THEN 4.0 * rest ELSE 0 END) / 1000000, 6) AS high FROM r"""))
def a21_score_bounds(spark, sf):
    t = D.token_events(spark, sf).withColumn("total", S.category_sum())
    t = t.withColumns({c: F.when(F.col("k") % 6 != 0, F.col(c)) for c in ("cache_write", "output")})
    t = t.withColumns({f"w_{c}": F.lit(w) for c, w in zip(S.CATEGORIES, (1.0, 0.25, 2.0, 4.0, 4.0))})
    return V.tt_score_bounds(t, 1e6).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query()
def a22_basis(spark, sf):
    w = _category_prices(spark, sf).withColumnRenamed("price", "weight")
    lost = V.extends_basis(w, w.where("category <> 'cache_write'"), ["model"]).agg(F.count(F.lit(1)).alias("lost"))
    return V.basis_id(w, ["model"]).join(lost)


@query(with_sql("ev quota", "SELECT provider, profile, source, account, min(us) AS first_us, max(us) AS last_us, count(*) AS readings, (SELECT count(DISTINCT account) FROM quota) > 3 AS truncated FROM quota GROUP BY 1, 2, 3, 4 ORDER BY readings DESC, account LIMIT 3"))
def a23_account_inventory(spark, sf):
    return A.account_inventory(D.quota_snapshots(spark, sf), 3)


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n * (copies - 1)), 0) AS BIGINT) AS extra FROM (SELECT md5(text) AS h, count(*) AS copies, count(DISTINCT doc_id) AS files, max(n_chars) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)")
def a24_repeat_fingerprints(spark, sf):
    d = D.read(spark, sf, "documents").withColumn("h", F.md5("text"))
    return A.repeat_fingerprints(d, ["h"], "doc_id", "n_chars")


@query(with_sql("ev", "SELECT count(*) FILTER (kinds = 1) AS repeated, count(*) FILTER (kinds > 1) AS conflicting FROM (SELECT user_id, event_type, k, count(*) AS n, count(DISTINCT (inc // 1000)) AS kinds FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 1)"))
def a25_response_repeats(spark, sf):
    e = D.events(spark, sf).withColumn("amount", F.floor(F.col("inc") / 1000))
    return A.response_repeats(e, ["user_id", "event_type", "k"], ["amount"])


@query(with_sql("ev tok", "SELECT count(*) AS responses, count(*) FILTER (total = uncached+cache_read+cache_write+output+reasoning) AS complete, count(*) FILTER (k % 2 = 1) AS with_lineage, count(*) FILTER (quality = 'Missing') AS untimed FROM tok"))
def a26_response_coverage(spark, sf):
    t = D.token_events(spark, sf).withColumn("parent_id", F.when(F.col("k") % 2 == 1, F.col("event_id"))).withColumn("us", F.when(F.col("quality") == "Valid", F.col("us")))
    return A.response_coverage(t)


@query(with_sql("ev tok", "SELECT CAST(sum(total) AS BIGINT) AS with_model, CAST(sum(total) AS BIGINT) AS with_effort, CAST(sum(total) FILTER (captured_us > us) AS BIGINT) AS late, 0::BIGINT AS unknown_collection, CAST(sum(total) AS BIGINT) AS total FROM tok"))
def a27_evaluation_coverage(spark, sf):
    return A.evaluation_coverage(D.token_events(spark, sf))


@query(with_sql("ev tok", "SELECT model, flag, count(*) AS rows FROM (SELECT model, 'late' AS flag FROM tok WHERE captured_us > us UNION ALL SELECT model, 'untimed' FROM tok WHERE quality = 'Missing') GROUP BY 1, 2"))
def a28_flag_counts(spark, sf):
    flags = J.reasons(late=F.col("captured_us") > F.col("us"), untimed=F.col("quality") == "Missing")
    return A.flag_counts(D.token_events(spark, sf).withColumn("flags", flags), ["model"])


@query(with_sql("ev", "SELECT event_type, count(*) AS rows, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (json_extract(props, '$.k') IS NOT NULL) AS has_k, 0::BIGINT AS has_x FROM (SELECT ev.*, events.props FROM ev JOIN events USING (event_id)) GROUP BY 1"))
def a30_event_inventory(spark, sf):
    e = D.read(spark, sf, "events").withColumn("us", D.micros(F.col("ts")))
    return A.event_inventory(e, "event_type", {"k": F.get_json_object("props", "$.k"), "x": F.get_json_object("props", "$.x")})


@query(with_sql("ev", ", r AS (SELECT user_id AS session_id, max(us) AS last_us FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40), f AS (SELECT user_id AS session_id, max(us) AS fetched_us FROM ev WHERE k = 3 GROUP BY 1) SELECT session_id, last_us, fetched_us FROM r LEFT JOIN f USING (session_id) ORDER BY fetched_us ASC NULLS FIRST, last_us DESC, session_id LIMIT 10"))
def a31_rotate_candidates(spark, sf):
    t = D.token_events(spark, sf)
    return A.rotate_candidates(t, t.where("k = 3").select("session_id", F.col("us").alias("fetched_us")), 10, 40)


@query(with_sql("ev tok", ", c AS (SELECT effort, model, CAST(sum(total) AS BIGINT) AS tokens FROM tok GROUP BY 1, 2) SELECT effort, model, tokens, round(tokens / sum(tokens) OVER (PARTITION BY effort), 9) AS share FROM c"))
def a32_share_rows(spark, sf):
    return A.share_rows(D.token_events(spark, sf), ["effort"], "model").withColumn("share", F.round("share", 9))


@query(with_sql("led", "SELECT coalesce(m.model, l.model) AS model, m.model IS NOT NULL AS known, coalesce(l.total, 0) AS total FROM (VALUES ('AF'), ('ZZ')) m(model) FULL JOIN (SELECT model, CAST(sum(total) AS BIGINT) AS total FROM led GROUP BY 1) l ON m.model = l.model"))
def a33_model_catalog(spark, sf):
    return A.model_catalog(spark.createDataFrame([("AF",), ("ZZ",)], "model string"), D.order_ledger(spark, sf))


def _files_active(spark, sf):
    from ..sources.merge import active_generation

    return active_generation(_files(spark, sf).withColumnRenamed("file", "doc_id"), "path", "doc_id", "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY source || '/' || CAST(doc_id % 50 AS VARCHAR))")
def j2_active_only(spark, sf):
    return J.active_only(D.read(spark, sf, "labels").select("doc_id", "quality"), _files_active(spark, sf), "doc_id")


@query("SELECT l_orderkey, l_linenumber, coalesce(p.p_type, '(unknown)') AS part_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) p ON l_partkey = p_partkey")
def j3_session_dimension_join(spark, sf):
    parts = D.read(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return J.session_dimension_join(D.read(spark, sf, "lineitem"), parts, "l_partkey", {"part_type": "p_type"}).select("l_orderkey", "l_linenumber", "part_type")


@query(with_sql("ev claims", "SELECT e.event_id, CASE WHEN count(DISTINCT c.account) = 1 THEN min(c.account) END AS account, CASE count(DISTINCT c.account) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Associated' ELSE 'Conflicting' END AS association FROM ev e LEFT JOIN claims c ON c.session_id = e.user_id AND e.us BETWEEN c.from_us AND c.to_us GROUP BY 1"))
def j4_associate_account(spark, sf):
    return J.associate_account(D.token_events(spark, sf).select("event_id", "session_id", "us"), D.account_assertions(spark, sf)).select("event_id", "account", "association")


@query(with_sql("ev", f"SELECT user_id AS session_id, min(us) AS from_us, max(us) AS to_us, 'owner' AS account FROM ev WHERE us <= {DAY0 + 480 * HOUR} GROUP BY 1"))
def j5_derive_associations(spark, sf):
    return J.derive_associations(D.token_events(spark, sf), ["session_id"], "owner", DAY0 + 480 * HOUR)


@query(with_sql("led rates", "SELECT led.model, count(*) AS items, count(price) AS priced, CAST(sum(total * price) AS DOUBLE) AS amount FROM led LEFT JOIN rates r ON led.model = r.model AND (r.from_day IS NULL OR day >= r.from_day) AND (r.to_day IS NULL OR day < r.to_day) GROUP BY 1"))
def j6_price_as_of(spark, sf):
    p = J.price_as_of(D.order_ledger(spark, sf), D.price_rates(spark, sf))
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("items"), F.count("price").alias("priced"), F.sum(F.col("total") * F.col("price")).cast("double").alias("amount"))


@query(with_sql("led server", "SELECT coalesce(a.day, b.day) AS day, coalesce(native, 0) AS native, coalesce(ref, 0) AS reference, coalesce(native, 0) - coalesce(ref, 0) AS difference, CASE WHEN coalesce(ref, 0) <> 0 THEN round((coalesce(native, 0) - ref) * 100.0 / ref, 6) END AS percent, coalesce(native, 0) <> coalesce(ref, 0) AS different FROM (SELECT day, CAST(sum(total) AS BIGINT) AS native FROM led GROUP BY 1) a FULL JOIN (SELECT day, server_total AS ref FROM server) b ON a.day = b.day"))
def j14_reconcile_totals(spark, sf):
    r = J.reconcile_totals(D.order_ledger(spark, sf), D.server_daily(spark, sf).withColumnRenamed("server_total", "total"), "day", "total")
    return r.withColumn("percent", F.round("percent", 6))


@query(with_sql("led server", ", d AS (SELECT day, CAST(sum(total) AS BIGINT) AS t FROM led GROUP BY 1) SELECT 'day' AS grain, strftime(s.day, '%Y-%m-%d') AS label, server_total, t AS local_total, round(t / server_total, 9) AS ratio FROM server s LEFT JOIN d ON s.day = d.day UNION ALL SELECT 'lifetime', 'all', CAST((SELECT sum(server_total) FROM server) AS BIGINT), CAST((SELECT sum(t) FROM d) AS BIGINT), round((SELECT sum(t) FROM d) / (SELECT sum(server_total) FROM server), 9)"))
def j15_compare_server_local(spark, sf):
    c = J.compare_server_local(D.server_daily(spark, sf), D.order_ledger(spark, sf), {"day": ["day"], "lifetime": []})
    return c.withColumn("ratio", F.round("ratio", 9))


@query(with_sql("led server", ", c AS (SELECT day, CASE WHEN day(day) % 7 = 0 THEN 0 ELSE server_total END AS credits FROM server), p AS (SELECT day, CAST(sum(total) AS DOUBLE) / 100000 AS percent FROM led WHERE month(day) <> 2 GROUP BY 1), j AS (SELECT coalesce(c.day, p.day) AS day, credits, percent FROM c FULL JOIN p ON c.day = p.day) SELECT day, array_to_string(list_filter([CASE WHEN credits IS NULL OR percent IS NULL THEN 'date-not-in-both-reports' END, CASE WHEN credits = 0 THEN 'zero-native-credits' END, CASE WHEN percent BETWEEN 0 AND 0.01 THEN 'zero-or-tiny-relative-usage' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN credits <> 0 AND percent > 0.01 THEN round(credits / percent, 6) END AS ratio FROM j"))
def j12_pair_daily(spark, sf):
    c = D.server_daily(spark, sf).select("day", F.when(F.dayofmonth("day") % 7 == 0, 0).otherwise(F.col("server_total")).alias("credits"))
    p = D.order_ledger(spark, sf).where(F.month("day") != 2).groupBy("day").agg((F.sum("total").cast("double") / 100000).alias("percent"))
    return J.pair_daily(c, p).select("day", F.array_join("reasons", ",").alias("reasons"), F.round("ratio", 6).alias("ratio"))


@query(with_sql("led", ", a AS (SELECT day, model, CAST(sum(total) AS BIGINT) AS w FROM led GROUP BY 1, 2), l AS (SELECT day, model, w AS w_left FROM a WHERE day(day) % 2 = 0), r AS (SELECT day, model, CASE WHEN day(day) % 3 = 0 THEN w + 1 ELSE w END AS w_right FROM a WHERE day(day) % 5 <> 0) SELECT coalesce(l.day, r.day) AS day, coalesce(l.model, r.model) AS model, w_left, w_right, CASE WHEN l.day IS NULL OR r.day IS NULL THEN 'Unpaired' WHEN w_left <> w_right THEN 'UnequalWorkload' ELSE 'Paired' END AS pairing FROM l FULL JOIN r ON l.day = r.day AND l.model = r.model"))
def j13_pair_aligned(spark, sf):
    a = D.order_ledger(spark, sf).groupBy("day", "model").agg(F.sum("total").cast("long").alias("w"))
    right = a.where(F.dayofmonth("day") % 5 != 0).withColumn("w", F.when(F.dayofmonth("day") % 3 == 0, F.col("w") + 1).otherwise(F.col("w")))
    return J.pair_aligned(a.where(F.dayofmonth("day") % 2 == 0), right, ["day", "model"], "w")


@query("""WITH b AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN p + 1 ELSE p END AS p FROM b WHERE o_orderkey % 97 <> 0 UNION ALL SELECT -o_orderkey, p FROM b WHERE o_orderkey % 83 = 0)
    SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'Added' WHEN a.o_orderkey IS NULL THEN 'Removed' ELSE 'Changed' END AS change FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE a.p IS DISTINCT FROM b.p OR a.o_orderkey IS NULL OR b.o_orderkey IS NULL""")
def j20_table_diff(spark, sf):
    b = D.read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("p"))
    a = b.where("o_orderkey % 97 <> 0").withColumn("p", F.when(F.col("o_orderkey") % 89 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return J.table_diff(b, a.unionByName(b.where("o_orderkey % 83 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))), "o_orderkey")


@query("SELECT * FROM (VALUES ('doc_id', 'bigint', 'string', 'Changed'), ('text', 'string', NULL, 'Removed'), ('lang', 'string', NULL, 'Removed'), ('source', 'string', NULL, 'Removed'), ('n_chars', 'bigint', NULL, 'Removed'), ('page_id', NULL, 'bigint', 'Added'), ('url', NULL, 'string', 'Added'), ('html', NULL, 'string', 'Added')) v(\"column\", before, after, change)")
def j21_schema_diff(spark, sf):
    return J.schema_diff(D.read(spark, sf, "documents"), D.read(spark, sf, "pages").withColumn("doc_id", F.lit("x")))


@query("""WITH RECURSIVE edges AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
    d AS (SELECT parent AS node, 0 AS depth FROM edges WHERE child = 'N' || (SELECT c_nationkey FROM customer WHERE c_custkey = 1) UNION ALL SELECT e.child, depth + 1 FROM d JOIN edges e ON e.parent = d.node) SELECT node, min(depth) AS depth FROM d GROUP BY 1""")
def j22_agent_tree(spark, sf):
    return J.agent_tree(D.relationships(spark, sf), "C1")


@query("""WITH RECURSIVE edges AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
    threads AS (SELECT 'N' || n_nationkey AS thread, n_name AS title FROM nation UNION ALL SELECT 'C' || c_custkey, c_name FROM customer),
    w AS (SELECT thread, thread AS start FROM threads WHERE contains(lower(title), '00001') UNION SELECT e.parent, w.start FROM w JOIN edges e ON e.child = w.thread),
    r AS (SELECT thread, thread AS top FROM w UNION SELECT r.thread, e.parent FROM r JOIN edges e ON e.child = r.top)
    SELECT w.thread, bool_or(w.thread = w.start) AS matched, false AS cyclic, any_value(e.parent) AS parent, (SELECT min(top) FROM r WHERE r.thread = w.thread AND top NOT IN (SELECT child FROM edges)) AS root, false AS several_parents, any_value(t.thread) IS NULL AS missing FROM w LEFT JOIN edges e ON e.child = w.thread LEFT JOIN threads t ON t.thread = w.thread GROUP BY w.thread""")
def j23_browse_threads(spark, sf):
    n, c = D.read(spark, sf, "nation"), D.read(spark, sf, "customer")
    threads = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("thread"), F.col("n_name").alias("title")).unionByName(c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("thread"), F.col("c_name").alias("title")))
    return J.browse_threads(threads, D.relationships(spark, sf), "00001")


@query("SELECT conv_id, turn, role, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id) - 1 AS alternatives, (SELECT count(DISTINCT role) > 1 FROM conversations x WHERE x.conv_id = c.conv_id) AS conflict FROM conversations c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1")
def j24_catalog_reconcile(spark, sf):
    c = D.read(spark, sf, "conversations")
    return J.catalog_reconcile(c, "conv_id", [F.desc("turn"), F.col("role"), F.col("text")], ["role"]).select("conv_id", "turn", "role", "alternatives", "conflict")
