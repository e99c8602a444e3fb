"""Queries of what changed in a provider's documents."""

from __future__ import annotations

from decimal import Decimal

from ..operators.drift import DatedPaths, DriftRule, document_drift
from ..sources import adapters as D
from ..sources.adapters import DAY_US, with_sql
from .registry import query

REPORT_RULES = [
    DriftRule("@client_version", "Capability", stops="(?!@client_version$).*"),
    DriftRule("units", "Configuration", stops="days/.*", needed=True),
    DriftRule("limits/[^/]+/reached", "Blocking"),
    DriftRule("limits/[^/]+/plan", "Configuration"),
    DriftRule("days/[^/]+/surface/.*", "Revision", noise=Decimal("0.000000000001")),
    DriftRule("days/[^/]+/total", "Revision"),
]
REPORT_MEMBERS = {"limits": "key", "days": "date"}
REPORT_DAYS = DatedPaths("days/([^/]+)/.*", "start_date", "end_date")

DRIFT = f"""WITH dy AS (SELECT user_id AS u, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS t, min(epoch_us(ts)) AS us FROM events GROUP BY 1, 2),
    b AS (SELECT u, c, min(us) + c * {6 * DAY_US} AS began, min(n) AS a, max(n) AS z FROM dy CROSS JOIN range(1, 7) r(c) GROUP BY 1, 2),
    o AS (SELECT *, u * 10 + c AS id, CASE WHEN u % 7 = 0 AND c = 2 THEN 'B' ELSE 'A' END AS acc, began + CASE WHEN u % 13 = 0 AND c = 2 THEN {7 * DAY_US} ELSE 60000000 END AS coll, CASE WHEN (u + c) % 11 = 0 THEN 'Failed' ELSE 'Available' END AS st, CASE WHEN u % 6 = 0 AND c = 6 THEN '2' ELSE '1' END AS cv FROM b),
    l AS (SELECT *, lag(id) OVER w AS id0, lag(c) OVER w AS c0, lag(acc) OVER w AS acc0, lag(began) OVER w AS began0, lag(coll) OVER w AS coll0, lag(st) OVER w AS st0, lag(cv) OVER w AS cv0 FROM o WINDOW w AS (PARTITION BY u ORDER BY coll, id)),
    p AS (SELECT * FROM l WHERE acc = acc0 AND coll0 < began), same AS (SELECT * FROM p WHERE cv = cv0), ok AS (SELECT * FROM same WHERE st = 'Available' AND st0 = 'Available'),
    units AS (SELECT *, CASE WHEN c0 = 4 AND u % 8 = 0 THEN 'credits' ELSE 'percent' END AS x0, CASE WHEN c = 4 AND u % 8 = 0 THEN 'credits' ELSE 'percent' END AS x1 FROM ok),
    days AS (SELECT p.*, 'days/' || CAST(DATE '1970-01-01' + CAST(n AS INT) AS VARCHAR) || '/' AS f, n, t, (n + c0) % 9 <> 0 AS h0, (n + c) % 9 <> 0 AS h1 FROM units p JOIN dy USING (u) WHERE x0 = x1 AND n < began0 // {DAY_US}),
    f AS (SELECT u, id0, id, coll, acc, 'Capability' AS kind, '@client_version' AS field, cv0 AS v0, cv AS v1 FROM p WHERE cv <> cv0
      UNION ALL SELECT u, id0, id, coll, acc, 'Capability', '@state', st0, st FROM same WHERE st <> st0
      UNION ALL SELECT u, id0, id, coll, acc, 'Missingness', 'limits/extra/reported', CASE WHEN (u + c0) % 4 <> 0 THEN 'present' END, CASE WHEN (u + c) % 4 <> 0 THEN 'present' END FROM ok
      UNION ALL SELECT u, id0, id, coll, acc, 'Configuration', 'limits/primary/plan', CASE WHEN c0 = 5 AND u % 4 = 0 THEN 'pro' ELSE 'plus' END, CASE WHEN c = 5 AND u % 4 = 0 THEN 'pro' ELSE 'plus' END FROM ok
      UNION ALL SELECT u, id0, id, coll, acc, 'Blocking', 'limits/primary/reached', CAST((u + c0) % 3 = 0 AS VARCHAR), CAST((u + c) % 3 = 0 AS VARCHAR) FROM ok
      UNION ALL SELECT u, id0, id, coll, acc, 'Configuration', 'units', x0, x1 FROM units
      UNION ALL SELECT u, id0, id, coll, acc, 'Missingness', f || 'reported', CASE WHEN h0 THEN 'present' END, CASE WHEN h1 THEN 'present' END FROM days WHERE n > a AND n < z
      UNION ALL SELECT u, id0, id, coll, acc, 'Revision', f || 'total', CAST(t + CASE WHEN c0 >= 3 AND (n + u) % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR), CAST(t + CASE WHEN c >= 3 AND (n + u) % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) FROM days WHERE h0 AND h1
      UNION ALL SELECT u, id0, id, coll, acc, 'Numerical', f || 'surface/all', CAST(t % 1000 AS VARCHAR) || CASE WHEN c0 = 4 AND n % 2 = 0 THEN '.0000000000001' ELSE '' END, CAST(t % 1000 AS VARCHAR) || CASE WHEN c = 4 AND n % 2 = 0 THEN '.0000000000001' ELSE '' END FROM days WHERE h0 AND h1)
    SELECT u AS user_id, id0 AS before_id, id AS after_id, coll AS observed_us, acc AS account, kind, field, v0 AS before, v1 AS after FROM f WHERE v0 IS DISTINCT FROM v1"""


@query(DRIFT)
def w17_document_drift(spark, sf):
    return document_drift(D.observed_documents(spark, sf), ["user_id"], REPORT_RULES, REPORT_MEMBERS, ["client_version"], REPORT_DAYS)
