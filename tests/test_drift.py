"""Drift between documents (W17) on cases made by hand, and against plain recursion over random documents."""

import json
import random
from decimal import Decimal

from ledgerloom.operators.drift import DatedPaths, DriftRule, document_drift, flatten
from pyspark.sql import functions as F

ROW = "observation_id int, lane string, account string, evidence string, began_us long, collected_us long, state string, contract string, doc string"
RULES = [DriftRule("@contract", "Capability", stops="(?!@contract$).*"), DriftRule("limits/.*/used", None), DriftRule("limits/.*/reached", "Blocking"), DriftRule("limits/.*", "Configuration"), DriftRule("share", "Revision", noise=Decimal("1e-12"))]
DAY = 86_400_000_000


def drift(spark, rows, rules=RULES, members=None, **more):
    df = spark.createDataFrame(rows, ROW).withColumn("document", F.parse_json("doc")).drop("doc")
    out = document_drift(df, ["lane"], rules, members or {"limits": "key"}, ["contract"], **more).collect()
    return sorted(((r["lane"], r["before_id"], r["after_id"], r["kind"], r["field"], r["before"], r["after"]) for r in out), key=str)


def reading(i, doc, lane="a", account="A", evidence="ServerCorrelated", state="Available", contract="1", took=10, at=None):
    began = 1000 * i if at is None else at
    return (i, lane, account, evidence, began, began + took, state, contract, None if doc is None else json.dumps(doc))


def test_kinds_noise_and_missing_values(spark):
    x = {"limits": [{"key": "p/1", "plan": "plus", "used": 1, "reached": None, "deep": {"a": [1, {"b": 2}]}}], "share": 0.5, "other": 1}
    y = {"limits": [{"key": "q", "plan": "x", "reached": True}, {"key": "p/1", "plan": "pro", "used": 7, "reached": True, "deep": {"a": [1, {"b": 3}]}}], "share": 0.5000000000001, "other": 2}
    z = {"limits": [{"key": "p/1", "plan": None, "used": 7, "reached": True, "deep": {"a": [1, {"b": 3}]}}], "share": 0.51}
    got = drift(spark, [reading(1, x), reading(2, y), reading(3, z)])
    p = "limits/p~11"
    assert sorted(map(str, got)) == sorted(map(str, [
        ("a", 1, 2, "Configuration", f"{p}/plan", "plus", "pro"), ("a", 1, 2, "Missingness", f"{p}/reached", None, "true"), ("a", 1, 2, "Configuration", f"{p}/deep/a/1/b", "2", "3"),
        ("a", 1, 2, "Missingness", "limits/q/reported", None, "present"), ("a", 1, 2, "Numerical", "share", "0.5", "0.5000000000001"),
        ("a", 2, 3, "Missingness", f"{p}/plan", "pro", None), ("a", 2, 3, "Missingness", "limits/q/reported", "present", None), ("a", 2, 3, "Revision", "share", "0.5000000000001", "0.51"),
    ]))


def test_what_is_never_bridged(spark):
    a, b = {"share": 1}, {"share": 2}
    rows = [reading(i, a if i % 2 else b, lane) for lane in "abcdefg" for i in (1, 2, 3)]
    by = {(r[1], r[0]): n for n, r in enumerate(rows)}

    def put(lane, **more):
        rows[by[lane, 2]] = reading(2, b, lane, **more)

    put("a", account="B")  # another account between
    put("b", account=None)
    put("c", evidence="Guessed")
    put("d", took=5000)  # still being fetched while the next one is
    put("e", state="Failed")
    put("f", contract="2")
    got = drift(spark, rows)
    assert [r for r in got if r[0] in "abc"] == []
    assert [r for r in got if r[0] == "d"] == []  # collected in the order 1, 3, 2: 3 says what 1 said
    assert [r[3:] for r in got if r[0] == "e"] == [("Capability", "@state", "Available", "Failed"), ("Capability", "@state", "Failed", "Available")]
    assert [r[3:] for r in got if r[0] == "f"] == [("Capability", "@contract", "1", "2"), ("Capability", "@contract", "2", "1")]
    assert [r[3:] for r in got if r[0] == "g"] == [("Revision", "share", "1", "2"), ("Revision", "share", "2", "1")]
    assert got == drift(spark, [*rows, *rows])  # repeated readings
    assert drift(spark, rows[:0]) == []


def test_elements_of_one_name_are_not_compared(spark):
    one, two = {"limits": [{"key": "p", "plan": "x"}], "share": 1}, {"limits": [{"key": "p", "plan": "y"}, {"key": "p", "plan": "z"}, {"key": "q"}], "share": 2}
    assert [r[3:] for r in drift(spark, [reading(1, one), reading(2, two)])] == [("Revision", "share", "1", "2")]


def test_only_settled_days_inside_both_ranges(spark):
    rules = [DriftRule("units", "Configuration", stops="days/.*", needed=True), DriftRule("days/.*", "Revision")]
    days = DatedPaths("days/([^/]+)/.*", "start", "end")
    report = lambda start, end, units, **n: {"start": start, "end": end, "units": units, "days": [{"date": f"2024-01-{k[1:]}", "n": v} for k, v in n.items()]}
    base = 19723 * DAY  # 2024-01-01
    x = report("2024-01-01", "2024-01-31", "percent", d01=1, d02=1, d03=1, d09=1)
    y = report("2024-01-02", "2024-01-31", "percent", d03=2, d04=1, d09=2)
    rows = [reading(1, x, at=base + 5 * DAY), reading(2, y, at=base + 8 * DAY)]
    got = drift(spark, rows, rules, {"days": "date"}, dated=days)
    assert [r[3:] for r in got] == [("Missingness", "days/2024-01-04/reported", None, "present"), ("Revision", "days/2024-01-03/n", "1", "2")]
    for units in ("tokens", None):
        rows[1] = reading(2, {**y, "units": units}, at=base + 8 * DAY)
        assert [r[4] for r in drift(spark, rows, rules, {"days": "date"}, dated=days)] == ["units"]
    rows = [reading(1, {**x, "units": ""}, at=base + 5 * DAY), reading(2, {**y, "units": ""}, at=base + 8 * DAY)]
    assert drift(spark, rows, rules, {"days": "date"}, dated=days) == []


def random_document(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice("abc~/") + str(i): random_document(rng, depth - 1) for i in range(rng.randrange(4))}
    if depth and kind < 0.6:
        return [random_document(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, 1, -5, 2.5, "", "x"])


def plain_leaves(doc, path=""):
    items = doc.items() if isinstance(doc, dict) else enumerate(doc)
    for k, v in items:
        at = "/".join(([path] if path else []) + [str(k).replace("~", "~0").replace("/", "~1")])
        if isinstance(v, dict | list):
            yield from plain_leaves(v, at)
        else:
            yield at, v if v is None or isinstance(v, str) else json.dumps(v)


def test_flatten_takes_any_shape(spark):
    rng = random.Random(5)
    docs = [{"r": random_document(rng, 6), "s": random_document(rng, 3)} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)], "k int, d string").withColumn("d", F.parse_json("d"))
    got = sorted((r["k"], r["path"], str(r["value"])) for r in flatten(df, "d", {}).collect())
    assert got == sorted((i, p, str(v)) for i, d in enumerate(docs) for p, v in plain_leaves(d))


def test_numbers_with_exponents_are_compared_by_their_digits(spark):
    rows = [(1, '{"a": 0E-13, "b": 1E-13, "c": 2.5E+3, "d": 1E-30, "e": -1.50E+0, "f": 0}')]
    d = spark.createDataFrame(rows, "id long, text string").select("id", F.parse_json("text").alias("document"))
    got = {r.path: r.value for r in flatten(d, "document", {}).collect()}
    assert got == {"a": "0", "b": "0.0000000000001", "c": "2500", "d": "1.0E-30", "e": "-1.5", "f": "0"}
