"""Queries of counters, logs and ranges that grow: lineages of counters, tails of logs, kept resets, covered intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import crossing as C
from ..operators import lineage as L
from ..operators import windows as W
from ..sources import adapters as D
from ..sources import merge as G
from ..sources import samples as X
from ..sources.adapters import with_sql
from ..sources.event_log import parse_lines
from ..sources.shared import tasks_for
from ..streaming import resets as RT
from ..streaming import tail as T
from .queries_logs import drained
from .queries_meter import HOUR, MINUTE, OBS, _paths
from .queries_usage import PRICES, V, _category_prices
from .registry import ORACLE, query

# W2 over observations of which every 23rd is delivered once more, forty observations later
LINEAGE = OBS + """, q AS (SELECT c.event_id, c.session_id, 2 * c.event_id AS arrival, o.t, CASE WHEN c.has_last THEN o.inc END AS l, c.total AS a, false AS again FROM c JOIN o USING (event_id)
        UNION ALL SELECT c.event_id, c.session_id, 2 * c.event_id + 81, o.t, CASE WHEN c.has_last THEN o.inc END, 0, true FROM c JOIN o USING (event_id) WHERE c.event_id % 23 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n FROM q),
    walk AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS heads, CAST(0 AS BIGINT) AS high, CAST(NULL AS BIGINT) AS prev, '' AS transition, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM r
      UNION ALL SELECT r.session_id, r.n,
        CASE WHEN r.again THEN w.heads ELSE (list_filter(w.heads, lambda x: x <> r.t AND (r.l IS NULL OR r.l > r.t OR list_contains(w.heads, r.t) OR x <> r.t - r.l)) || [r.t])[-32:] END,
        CASE WHEN r.again THEN w.high ELSE greatest(w.high, r.t) END, CASE WHEN r.again THEN w.prev ELSE r.t END,
        CASE WHEN r.again THEN 'occurrence-retry' ELSE CASE WHEN w.prev IS NULL THEN 'first-cumulative' WHEN r.t < w.high THEN 'below-watermark/' || CASE WHEN r.t < w.prev THEN 'falling' WHEN r.t = w.prev THEN 'repeated' ELSE 'recovering' END WHEN r.t = w.high THEN 'at-watermark' ELSE 'above-watermark' END || CASE WHEN r.l IS NULL THEN '/unusable-last' ELSE '/usable-last' END END,
        CAST(r.a AS BIGINT), CASE WHEN r.again THEN 0 ELSE greatest(0, r.t - w.high) END,
        CASE WHEN r.again THEN 0 WHEN r.l <= r.t THEN CASE WHEN list_contains(w.heads, r.t) THEN 0 ELSE r.l END ELSE greatest(0, r.t - w.high) END
      FROM walk w JOIN r ON r.session_id = w.session_id AND r.n = w.n + 1),
    z AS (SELECT w.*, r.again, r.t < lag(w.high) OVER (PARTITION BY w.session_id ORDER BY w.n) AND NOT r.again AND r.l IS NULL AS dropped FROM walk w LEFT JOIN r ON r.session_id = w.session_id AND r.n = w.n)
    """


def _delivered(spark, sf):
    """The columns that the walk reads, once: a copy delivered later is a row made beside its first one, not a second derivation of all."""
    ident = F.col("source_event_id")
    o = D.token_observations(spark, sf).select("session_id", ident, "us", "total", "last", F.explode(F.when(ident % 23 == 0, F.array(2 * ident, 2 * ident + 81)).otherwise(F.array(2 * ident))).alias("arrival"))
    return L.lineage_steps(o, order=("arrival",), tasks=tasks_for(D.events(spark, sf)))  # as many as the observations have


@query(with_sql("ev", LINEAGE + "SELECT session_id, CAST(sum(a) AS BIGINT) AS reducer_total, CAST(sum(b) AS BIGINT) AS watermark_total, CAST(sum(c) AS BIGINT) AS lineage_total, count(*) FILTER (again) AS retries, count(*) FILTER (dropped) AS totals_only_drops, CAST(max(len(heads)) AS INT) AS most_heads, sum(a) = sum(b) AND sum(a) = sum(c) AS agree, count(*) FILTER (dropped) > 0 AS ambiguous FROM z WHERE n > 0 GROUP BY session_id"))
def w2_lineage_sessions(spark, sf):
    return L.lineage_totals(_delivered(spark, sf)).drop("incomplete_counters", "category_changes")


@query(with_sql("ev", LINEAGE + "SELECT transition, count(*) AS observations, count(*) FILTER (a <> b OR a <> c) AS disagreements, CAST(sum(a) AS BIGINT) AS reducer_tokens, CAST(sum(b) AS BIGINT) AS watermark_tokens, CAST(sum(c) AS BIGINT) AS lineage_tokens FROM z WHERE n > 0 GROUP BY transition"))
def w2_lineage_transitions(spark, sf):
    return L.lineage_transitions(_delivered(spark, sf))


FACTS = "SELECT 'token_count' AS nested, 'ledger' AS tab FROM ev UNION ALL SELECT 'turn_context', 'evidence' FROM ev WHERE k % 5 = 0 UNION ALL SELECT 'compacted', 'evidence' FROM ev WHERE k = 7"


@query(with_sql("ev", f"SELECT tab, nested, count(*) AS rows FROM ({FACTS}) GROUP BY 1, 2"))
def t1_stream_tail(spark, sf):
    """Logs of which half the files come after the stream was stopped: ledger and evidence under one manifest."""
    logs, tables, state, planned = (X.scratch(spark, n) for n in ("logs", "tables", "tail-state", "planned"))
    lines = X.log_lines(spark, sf).withColumn("part", F.pmod(F.xxhash64("file"), F.lit(2)))
    of = lambda *names: lambda df: parse_lines(df.select("file", "generation", "ordinal", "value"), "generation").where(F.col("nested").isin(*names))
    for part in (0, 1):
        lines.where(F.col("part") == part).select("value").write.text(f"{logs}/{part}")
        sink = T.write_together(tables, {"ledger": of("token_count"), "evidence": of("turn_context", "compacted")})
        q = T.stream_tail(spark, logs, planned).writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    found = [T.committed(spark, tables, name).groupBy("nested").agg(F.count(F.lit(1)).alias("rows")).withColumn("tab", F.lit(name)) for name in ("ledger", "evidence")]
    return found[0].unionByName(found[1])


@query(ORACLE["w7_detect_resets"])
def t10_stream_resets(spark, sf):
    """Readings in the order of their collection, so some come late; two thirds first, the rest after the stream was stopped."""
    path, state, out = (X.scratch(spark, n) for n in ("readings", "resets-state", "resets"))
    q = D.quota_snapshots(spark, sf).withColumn("arrival", F.col("collected_us"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (q.where("observation_id % 3 < 2"), q.where("observation_id % 3 = 2")):
            part.write.mode("append").parquet(path)
            s = RT.stream_resets(spark.readStream.schema(q.schema).parquet(path), arrival="arrival")
            s.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return RT.standing(spark.read.schema(s.schema).parquet(out)).select("account", "previous_us", "us", "previous_used", "used", "classification")
    finally:
        spark.conf.set(provider, before)


@query(ORACLE["s16_upsert_events"])
def s16_merge_sink(spark, sf):
    """The rows of s16_upsert_events, by day: the target, the batch, and the batch once more."""
    path = X.scratch(spark, "merged")
    t = D.token_events(spark, sf).select("event_id", F.when(F.col("k") % 2 != 0, F.col("model")).alias("model"), "total", "k", F.to_date("at").alias("day"))
    batch = t.where("k % 4 <> 0").select("event_id", F.lit("filled").alias("model"), (F.col("total") + 1).alias("total"), "day")
    G.merge_events(t.where("k % 3 <> 0").drop("k"), path, "event_id", ["model"], "day", 0)
    for number in (1, 1, 2):
        G.merge_events(batch, path, "event_id", ["model"], "day", number)
    return spark.read.parquet(f"{path}/rows").drop("day")


@query()
def m50_crossing_windows(spark, sf):
    """Paths of each model and day against a five-hour and a weekly allowance; every second day declares a reset in an hour, the others know nothing beyond it."""
    paths = _paths(spark, sf).withColumnRenamed("origin_us", "day_us")
    start = F.col("day_us") + F.col("step").cast("long") * (5 * MINUTE)
    cost = F.create_map(F.lit("FiveHour"), F.col("t") / 700.0, F.lit("Weekly"), F.col("t") / 8000.0)
    steps = paths.select("model", "day_us", "path", start.alias("from_us"), (start + 5 * MINUTE).alias("to_us"), cost.alias("costs"))
    origins = paths.select("model", "day_us").distinct()
    budgets = origins.select("model", "day_us", F.col("day_us").alias("origin_us"), F.explode(F.create_map(F.lit("FiveHour"), F.lit(90.0), F.lit("Weekly"), F.lit(60.0))).alias("window", "remaining"))
    budgets = budgets.withColumn("reset_us", F.col("origin_us") + F.when(F.col("window") == "FiveHour", HOUR).otherwise(48 * HOUR))
    at = F.col("day_us") + HOUR
    resets = origins.where((F.col("day_us") / D.DAY_US) % 2 == 0).select("model", "day_us", F.lit("FiveHour").alias("window"), at.alias("at_us"), (at + 5 * HOUR).alias("next_us"), F.lit(100.0).alias("remaining"), F.col("day_us").alias("declared_us"))
    outcomes = C.crossing_outcomes(steps, budgets, resets, ["model", "day_us"], F.col("origin_us") + 2 * HOUR)
    return C.crossing_report(outcomes, ["model", "day_us"])


@query(with_sql("ev turns", """, n AS (SELECT max(us) AS now FROM ev), it AS (SELECT user_id AS session_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS turn, us, event_type AS item FROM ev),
    l AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) = 1), i AS (SELECT session_id, turn, max(us) AS item_us, arg_max(item, (us, item)) AS item FROM it GROUP BY 1, 2),
    o AS (SELECT l.session_id, l.turn, CASE WHEN ended_us IS NULL THEN 'in_progress' ELSE 'completed' END AS status, started_us, CASE WHEN ended_us IS NULL THEN i.item END AS last_item, CASE WHEN ended_us IS NULL THEN greatest(started_us, i.item_us) ELSE ended_us END AS observed_us, now FROM l LEFT JOIN i ON i.session_id = l.session_id AND i.turn = l.turn CROSS JOIN n),
    s AS (SELECT *, CASE WHEN status = 'completed' THEN 'Completed' WHEN now - observed_us <= 7200000000 THEN 'RecentlyWorking' ELSE 'StaleInProgress' END AS state FROM o)
    SELECT session_id, turn, status, started_us, state, observed_us, last_item FROM s WHERE state <> 'Completed' OR observed_us >= now - 86400000000 ORDER BY CASE state WHEN 'RecentlyWorking' THEN 0 WHEN 'StaleInProgress' THEN 1 ELSE 2 END, observed_us DESC, session_id LIMIT 150"""))
def w16_recent_threads(spark, sf):
    t = D.turns(spark, sf).withColumn("status", F.when(F.col("ended_us").isNull(), "in_progress").otherwise("completed"))
    e = D.events(spark, sf)
    items = e.select(F.col("user_id").alias("session_id"), F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 4).alias("turn"), "us", F.col("event_type").alias("item"))
    now = e.agg(F.max("us")).first()[0]
    return W.recent_threads(t, items, "session_id", F.lit(now).cast("long"), 2 * HOUR)


@query(with_sql("ev tok", PRICES + " SELECT round(CAST(sum(tokens * price) AS DOUBLE), 4) AS covered, false AS unsupported, round(CAST(sum(tokens * price) AS DOUBLE) / 1000000, 6) AS score FROM j WHERE model NOT IN (SELECT model FROM j WHERE price IS NULL)"))
def a20_supported_score(spark, sf):
    """The exact score of the models that have a weight for every category in use."""
    cells = V.unpivot(D.token_events(spark, sf).select("event_id", "model", *S.CATEGORIES), ["event_id", "model"]).where("tokens > 0")
    weights = _category_prices(spark, sf).withColumnRenamed("price", "weight")
    lacking = cells.select("model", "category").distinct().join(weights, ["model", "category"], "left_anti").select("model").distinct()
    out = V.tt_score_exact(cells.join(lacking, "model", "left_anti"), weights, 1e6, ["model"])
    return out.withColumns({"covered": F.round(F.col("covered").cast("double"), 4), "score": F.round("score", 6)})
