"""The library's logical tables, derived by Spark from generic event, order and document tables.

Times are `at` (TIMESTAMP_NTZ, UTC) and `us` (microseconds since 1970).  Missing stays NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import tasks_for

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
WEEK_US = 7 * DAY_US


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, at, us, user_id, event_type, value, k, inc."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"), micros(F.col("ts")).alias("us"), "user_id", "event_type", "value", k.alias("k"), F.round(F.col("value") * 100).cast("long").alias("inc"))


def effort(k: Column) -> Column:
    return F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high")


def counters(total: Column) -> dict[str, Column]:
    """Input, cached, write, output and reasoning counters as fixed parts of a total."""
    share = lambda p: F.floor(total * p / 100).cast("long")
    return {"input": share(80), "cached": share(50), "cache_write": share(10), "output": share(20), "reasoning": share(10), "total": total.cast("long")}


def token_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cumulative counters per session, with nullable structs `total` and `last`."""
    e = events(spark, sf_dir)
    e = e.repartition(tasks_for(e), "user_id")
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("epoch", F.sum((F.col("k") % 50 == 0).cast("int")).over(order))
    e = e.withColumn("run", F.sum("inc").over(Window.partitionBy("user_id", "epoch").orderBy("event_id")))
    pack = lambda c: F.struct(*(v.alias(n) for n, v in counters(c).items()))
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("source_event_id"), "us", (F.col("us") + (F.col("k") % 7) * 60_000_000).alias("captured_us"),
        F.col("event_type").alias("model"), effort(F.col("k")).alias("effort"), pack(F.col("run")).alias("total"), F.when(F.col("k") % 4 == 1, pack(F.col("inc"))).alias("last"),
    )


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of disjoint increments."""
    e = events(spark, sf_dir)
    c = counters(F.col("inc"))
    uncached = F.greatest(F.lit(0), F.greatest(F.lit(0), c["input"] - c["cached"]) - c["cache_write"])
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), "at", "us", (F.col("us") + (F.col("k") % 7) * 60_000_000).alias("captured_us"), F.col("event_type").alias("model"), effort(F.col("k")).alias("effort"),
        uncached.alias("uncached"), c["cached"].alias("cache_read"), c["cache_write"].alias("cache_write"), F.greatest(F.lit(0), c["output"] - c["reasoning"]).alias("output"), c["reasoning"].alias("reasoning"), c["total"].alias("total"),
        F.when(F.col("k") % 33 == 0, "Missing").otherwise("Valid").alias("quality"), "k",
    )


def quota_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter readings: percent of a weekly allowance used, by account."""
    e = events(spark, sf_dir).withColumn("cell", F.floor(F.col("us") / WEEK_US))
    cell = Window.partitionBy("event_type", "cell")
    run = F.sum("inc").over(cell.orderBy("event_id"))
    used = F.floor(run * 1000 / (F.sum("inc").over(cell) * 11)).cast("double")
    return e.select(
        F.lit("codex").alias("provider"), F.lit("default").alias("profile"), F.lit("Weekly").alias("kind"), F.lit("x-app-server:y").alias("source"), F.col("event_type").alias("account"),
        F.lit(None).cast("string").alias("limit_id"), F.lit(None).cast("string").alias("plan"), F.lit(None).cast("string").alias("session"), F.lit(10080).alias("window_minutes"),
        F.col("event_id").alias("observation_id"), "at", "us", F.when(F.col("k") % 25 != 0, used).alias("used"), ((F.col("cell") + 1) * WEEK_US).alias("resets_us"), (F.col("us") + (F.col("k") % 7) * 60_000_000).alias("collected_us"), "k",
    )


def tied_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quota_snapshots with repeated and conflicting readings at equal times."""
    q = quota_snapshots(spark, sf_dir)
    extra = q.where("k % 40 = 0").withColumn("observation_id", F.col("observation_id") + 1_000_000_000).withColumn("used", F.when(F.col("k") % 80 == 0, F.col("used") + 1).otherwise(F.col("used")))
    return q.unionByName(extra)


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges region -> nation -> customer."""
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return n.select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child")).unionByName(c.select(name("N", "c_nationkey").alias("parent"), name("C", "c_custkey").alias("child")))


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user is a subagent of the user before."""
    u = events(spark, sf_dir).select("user_id").distinct().where("user_id % 3 = 1")
    return u.select((F.col("user_id") - 1).alias("parent"), F.col("user_id").alias("child"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events of a session make a turn; open when the last one says so."""
    e = events(spark, sf_dir).withColumn("turn", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 4))
    g = e.groupBy(F.col("user_id").alias("session_id"), "turn").agg(F.min("us").alias("started_us"), F.max("us").alias("last_us"), F.max_by("k", "event_id").alias("k"))
    return g.select("session_id", "turn", "started_us", F.when(F.col("k") % 5 != 0, F.col("last_us")).alias("ended_us"), "last_us")


def context_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.col("user_id").alias("session_id"), "at", "us", F.col("inc").alias("input"), F.lit(25840).cast("long").alias("window"), (F.col("k") == 7).alias("compaction"))


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger ledger: line items as increments, customers as sessions, priorities as repositories."""
    l, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("session_id"), F.col("l_shipdate").cast("date").alias("day"), F.concat("l_returnflag", "l_linestatus").alias("model"), F.round(F.col("l_quantity") * 100).cast("long").alias("total"), F.col("o_orderpriority").alias("repository"))


def price_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two validity intervals per model, with a price for each."""
    m = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model")).distinct()
    cut = F.to_date(F.lit("1995-07-01"))
    early = m.select("model", F.lit(None).cast("date").alias("from_day"), cut.alias("to_day"), (F.ascii("model") * F.lit(0.5)).cast("decimal(18,6)").alias("price"))
    late = m.select("model", cut.alias("from_day"), F.lit(None).cast("date").alias("to_day"), (F.ascii("model") * F.lit(0.75)).cast("decimal(18,6)").alias("price"))
    return early.unionByName(late)


def account_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which account a session's rows belong to, and from when to when; some sessions are claimed twice."""
    g = events(spark, sf_dir).groupBy("user_id").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"))
    a = g.select(F.col("user_id").alias("session_id"), "from_us", "to_us", (F.col("user_id") % 5).alias("account"), F.col("from_us").alias("asserted_us"))
    second = a.where("session_id % 11 = 0").withColumn("account", F.col("account") + 100)
    return a.unionByName(second)


def server_daily(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    """A provider's daily totals, a little below the ledger's, with a day missing each month.  ledger: the order ledger or its sums, where the caller has them."""
    d = (order_ledger(spark, sf_dir) if ledger is None else ledger).groupBy("day").agg(F.sum("total").alias("total"))
    return d.where(F.dayofmonth("day") != 13).select("day", F.floor(F.col("total") * 97 / 100).cast("long").alias("server_total"))


def daily_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures of the daily report; the second changes some days."""
    d = server_daily(spark, sf_dir).crossJoin(F.broadcast(spark.range(1, 4).select(F.col("id").cast("int").alias("capture"))))
    return d.withColumn("server_total", F.when((F.col("capture") == 2) & (F.dayofmonth("day") % 10 == 3), F.col("server_total") + 1).otherwise(F.col("server_total")))


def observed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six readings of each user's usage report and limits as documents; some have failed, overlap, or are of another account."""
    e = events(spark, sf_dir)
    day = e.withColumn("n", F.unix_date(F.col("at").cast("date"))).groupBy("user_id", "n").agg(F.sum("inc").alias("t"), F.min("us").alias("us"))
    d = day.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(6))))
    u, c, n = F.col("user_id"), F.col("c"), F.col("n")
    total = F.col("t") + F.when((c >= 3) & ((n + u) % 5 == 0), 1).otherwise(0)
    share = (F.col("t") % 1000).cast("decimal(20,13)") + F.when((c == 4) & (n % 2 == 0), F.lit("0.0000000000001").cast("decimal(20,13)")).otherwise(F.lit("0").cast("decimal(20,13)"))
    report = F.struct(F.date_from_unix_date(n).cast("string").alias("date"), total.alias("total"), F.struct(share.cast("decimal(20,13)").alias("all")).alias("surface"))
    g = d.groupBy("user_id", "c").agg(F.min("us").alias("us"), F.min("n").alias("a"), F.max("n").alias("z"), F.collect_list(F.when((n + c) % 9 != 0, report)).alias("days"))
    limit = lambda key, plan, reached: F.struct(F.lit(key).alias("key"), plan.alias("plan"), reached.alias("reached"), (u * 10 + c).alias("used"))
    first = limit("primary", F.when((c == 5) & (u % 4 == 0), "pro").otherwise("plus"), (c + u) % 3 == 0)
    limits = F.when((u + c) % 4 != 0, F.array(first, limit("extra", F.lit("plus"), F.lit(False)))).otherwise(F.array(first))
    units = F.when((c == 4) & (u % 8 == 0), "credits").otherwise("percent")
    iso = lambda x: F.date_from_unix_date(x).cast("string")
    body = F.to_json(F.struct(units.alias("units"), iso(F.col("a")).alias("start_date"), iso(F.col("z")).alias("end_date"), F.col("days"), limits.alias("limits")))
    began = F.col("us") + c * 6 * DAY_US
    return g.select(
        (u * 10 + c).alias("observation_id"), "user_id", F.when((u % 7 == 0) & (c == 2), "B").otherwise("A").alias("account"), F.lit("ServerCorrelated").alias("evidence"), began.alias("began_us"),
        (began + F.when((u % 13 == 0) & (c == 2), 7 * DAY_US).otherwise(60_000_000)).alias("collected_us"), F.when((u + c) % 11 == 0, "Failed").otherwise("Available").alias("state"),
        F.when((u % 6 == 0) & (c == 6), "2").otherwise("1").alias("client_version"), F.parse_json(body).alias("document"),
    )


#: The same tables in DuckDB's SQL, as common table expressions.
SQL = {
    "ev": "ev AS (SELECT event_id, ts AS at, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract(props,'$.k') AS INT) AS k, CAST(round(value*100) AS BIGINT) AS inc FROM events)",
    "tok": """tok AS (SELECT event_id, user_id AS session_id, at, us, us + (k % 7) * 60000000 AS captured_us, event_type AS model,
        CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS effort,
        greatest(0, greatest(0, inc*80//100 - inc*50//100) - inc*10//100) AS uncached, inc*50//100 AS cache_read, inc*10//100 AS cache_write,
        greatest(0, inc*20//100 - inc*10//100) AS output, inc*10//100 AS reasoning, inc AS total,
        CASE WHEN k % 33 = 0 THEN 'Missing' ELSE 'Valid' END AS quality, k FROM ev)""",
    "quota": """quota AS (SELECT 'codex' AS provider, 'default' AS profile, 'Weekly' AS kind, 'x-app-server:y' AS source, event_type AS account, 10080 AS window_minutes,
        event_id AS observation_id, at, us, CASE WHEN k % 25 <> 0 THEN CAST(CAST(sum(inc) OVER (PARTITION BY event_type, us // 604800000000 ORDER BY event_id) AS BIGINT) * 1000
        // (CAST(sum(inc) OVER (PARTITION BY event_type, us // 604800000000) AS BIGINT) * 11) AS DOUBLE) END AS used,
        (us // 604800000000 + 1) * 604800000000 AS resets_us, us + (k % 7) * 60000000 AS collected_us, k FROM ev)""",
    "edges": "edges AS (SELECT DISTINCT user_id - 1 AS parent, user_id AS child FROM events WHERE user_id % 3 = 1)",
    "turns": """turns AS (SELECT session_id, turn, min(us) AS started_us, CASE WHEN arg_max(k, event_id) % 5 <> 0 THEN max(us) END AS ended_us, max(us) AS last_us
        FROM (SELECT *, user_id AS session_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS turn FROM ev) GROUP BY session_id, turn)""",
    "led": "led AS (SELECT o_custkey AS session_id, CAST(l_shipdate AS DATE) AS day, l_returnflag || l_linestatus AS model, CAST(round(l_quantity*100) AS BIGINT) AS total, o_orderpriority AS repository FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "rates": """rates AS (SELECT model, NULL::DATE AS from_day, DATE '1995-07-01' AS to_day, CAST(ascii(model) * 0.5 AS DECIMAL(18,6)) AS price FROM (SELECT DISTINCT l_returnflag || l_linestatus AS model FROM lineitem)
        UNION ALL SELECT model, DATE '1995-07-01', NULL::DATE, CAST(ascii(model) * 0.75 AS DECIMAL(18,6)) FROM (SELECT DISTINCT l_returnflag || l_linestatus AS model FROM lineitem))""",
    "claims": """claims0 AS (SELECT user_id AS session_id, min(us) AS from_us, max(us) AS to_us, user_id % 5 AS account FROM ev GROUP BY user_id),
        claims AS (SELECT *, from_us AS asserted_us FROM claims0 UNION ALL SELECT session_id, from_us, to_us, account + 100, from_us FROM claims0 WHERE session_id % 11 = 0)""",
    "server": "server AS (SELECT day, CAST(sum(total) AS BIGINT) * 97 // 100 AS server_total FROM led GROUP BY day HAVING day(day) <> 13)",
    "ties": "ties AS (SELECT * FROM quota UNION ALL SELECT * REPLACE (observation_id + 1000000000 AS observation_id, CASE WHEN k % 80 = 0 THEN used + 1 ELSE used END AS used) FROM quota WHERE k % 40 = 0)",
}


def with_sql(names: str, body: str) -> str:
    """A query over the named tables; body may start with further `, name AS (...)` tables."""
    text = "WITH RECURSIVE " + ", ".join(SQL[n] for n in names.split()) + " " + body
    return re.sub(r"\bat\b(?=(?:[^']*'[^']*')*[^']*$)", '"at"', text)  # DuckDB reserves the word; quoted text stays
