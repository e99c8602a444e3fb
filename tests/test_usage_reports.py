"""Usage reports in pages: no row holds a whole report, and the state is that of all its pages."""

import json

from ledgerloom.sources import reports, samples
from pyspark.sql import functions as F


def body(*threads, status="ok"):
    return json.dumps({"status": status, "lifetime_tokens": 9, "threads": [dict(zip(("id", "model", "effort", "tokens"), t)) for t in threads]})


def test_pages_make_one_report(spark):
    a, b = ("1", "m", "low", 3), ("2", "m", "low", 4)
    rows = [("sound", body(a)), ("sound", body(b)), ("twice", body(a)), ("twice", body(b, a)), ("negative", body(a)), ("negative", body(("2", "m", "low", -1))), ("partly", body()), ("partly", body(a)), ("none", body()), ("off", body(status="unavailable")), ("broken", "{"), (None, body(a)), ("other", body(status="new"))]
    got = reports.read_usage_reports(spark.createDataFrame(rows, "report_id string, body string")).collect()
    assert {r.report_id: r.state for r in got} == {"sound": "Available", "twice": "Conflict", "negative": "Invalid", "partly": "Available", "none": "Empty", "off": "Unavailable", "broken": "Invalid", None: "Available", "other": "Unsupported"}
    assert sorted((r.report_id, r.thread_id, r.tokens) for r in got if r.report_id in ("sound", "twice", "partly")) == [("partly", "1", 3), ("sound", "1", 3), ("sound", "2", 4), ("twice", "1", 3), ("twice", "1", 3), ("twice", "2", 4)]
    assert [r.thread_id for r in got if r.report_id in ("none", "off", "broken", "other")] == [None] * 4


def test_no_page_holds_more_threads_than_its_sessions_have(spark):
    pages = samples.usage_bodies(spark, "/root/testdata/sf0.1").select(F.size(F.from_json("body", reports.USAGE)["threads"]).alias("n"))
    assert pages.agg(F.max("n")).first()[0] <= 3 * samples.PAGE_SESSIONS
