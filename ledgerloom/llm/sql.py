"""DuckDB SQL for the queries that SQL can express.  The others are tested against brute force in tests/llm."""

from __future__ import annotations

from .secret_scan import RULES

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(rule) -> str:
    inner = "(?i:password|passwd|secret|token|api_?key)"
    return _literal(rule.pattern.replace(inner, f"(?:{_ANY_CASE})"))


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(f"SELECT doc_id, {_literal(r.kind)} AS kind, {i} AS k, {r.least} AS least, regexp_split_to_array(t, {_pattern(r)}) AS g, regexp_extract_all(t, {_pattern(r)}, 0) AS f, regexp_extract_all(t, {_pattern(r)}, {r.group}) AS v FROM d WHERE regexp_matches(t, {_pattern(r)})" for i, r in enumerate(RULES))}),
x AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, k, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(f[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS a, length(f[i]) AS n FROM x WHERE length(v[i]) >= least),
p AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""

JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), '|'))) ELSE doc_id END AS class_id FROM g),
e AS (SELECT doc_id, md5(unnest(s)) AS h FROM g),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM b JOIN c cu ON cu.doc_id = u JOIN c cv ON cv.doc_id = v WHERE k >= 0.8 * (cu.n + cv.n - k) - 1e-9),
r AS (SELECT doc_id AS u, doc_id AS v FROM c UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT c.doc_id, c.class_id, min(r.v) AS group_id, (SELECT count(*) FROM l WHERE l.u = c.doc_id) AS n_links, min(r.v) = c.doc_id AS kept FROM c JOIN r ON r.u = c.doc_id GROUP BY c.doc_id, c.class_id
"""

_DIGIT = lambda j: f"(strpos('0123456789abcdef', substr(h, {j}, 1)) - 1)"
_FIVE = lambda i: "(" + " + ".join(f"{_DIGIT(5 * i + j + 1)} * {16 ** (4 - j)}" for j in range(5)) + ")"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_FIVE(i)} >> {s}) & 31 AS BIGINT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_REST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1))"

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, max(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
    array_to_string(list_reverse(string_split({_HOST}, '.')), ',') || ')' || CASE WHEN {_REST} = '' THEN '/' ELSE {_REST} END AS url_key, make_timestamp((1704067200 + page_id) * 1000000) AS capture_ts, true AS intact
FROM p JOIN f ON p.t = f.t
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, min(r.w) AS component_id, min(r.w) = v.vec_id AS kept FROM v JOIN r ON r.u = v.vec_id GROUP BY v.vec_id
"""

_LOWER = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = lambda text: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

MERKLE = f"""
WITH RECURSIVE tab AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS c FROM documents UNION ALL SELECT doc_id, substr(s, 2), xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON k = 8 AND i = xor(crc.c & 255, ascii(substr(s, 1, 1))) WHERE s <> ''),
altered AS (SELECT doc_id FROM crc WHERE s = '' AND xor(c, 4294967295) % 3 = 0),
leaf AS (SELECT d.doc_id, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size, {_LEAF("text")} AS leaf,
    CASE WHEN d.doc_id IN (SELECT a.doc_id FROM altered a) THEN {_LEAF(_LOWER("text"))} ELSE {_LEAF("text")} END AS folded FROM documents d),
low AS (SELECT tree, 0 AS height, pos, size, leaf AS hash FROM leaf UNION ALL
    SELECT tree, height + 1, pos // 8, (size + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY tree, height, pos // 8, size),
sub AS (SELECT tree, hash AS subroot, height AS ends, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
high AS (SELECT 100 AS height, pos, size, subroot AS hash FROM sub UNION ALL SELECT height + 1, pos // 8, (size + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY height, pos // 8, size),
node AS (SELECT tree, height, pos, hash, size FROM low WHERE size > 1 UNION ALL SELECT '', height, pos, hash, size FROM high WHERE size > 1),
up AS (SELECT doc_id, l.tree AS own, CASE WHEN l.size > 1 THEN l.tree ELSE '' END AS tree, CASE WHEN l.size > 1 THEN 0 ELSE 100 END AS height, CASE WHEN l.size > 1 THEN l.pos ELSE s.pos END AS pos, folded, '' AS proof FROM leaf l JOIN sub s ON s.tree = l.tree
    UNION ALL SELECT u.doc_id, u.own, CASE WHEN n.size > 8 OR u.tree = '' THEN u.tree ELSE '' END, CASE WHEN n.size > 8 OR u.tree = '' THEN u.height + 1 ELSE 100 END, CASE WHEN n.size > 8 OR u.tree = '' THEN u.pos // 8 ELSE any_value(s.pos) END,
        sha256(string_agg(CASE WHEN n.pos = u.pos THEN u.folded ELSE n.hash END, '' ORDER BY n.pos)), u.proof || coalesce(string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos <> u.pos), '')
    FROM up u JOIN node n ON n.tree = u.tree AND n.height = u.height AND n.pos // 8 = u.pos // 8 JOIN sub s ON s.tree = u.own GROUP BY u.doc_id, u.own, u.tree, u.height, u.pos, u.folded, u.proof, n.size),
root AS (SELECT hash AS root FROM high WHERE size = 1),
ended AS (SELECT doc_id, arg_max(folded, length(proof) + height * 1000000) AS folded_root, arg_max(proof, length(proof) + height * 1000000) AS proof FROM up GROUP BY doc_id)
SELECT l.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM leaf l JOIN sub s ON s.tree = l.tree JOIN ended e ON e.doc_id = l.doc_id CROSS JOIN root
"""

_TERMS = lambda c: f"regexp_extract_all({_LOWER(c)}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL = f"""
WITH d AS (SELECT doc_id, {_TERMS("text")} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM c GROUP BY doc_id, n, term),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS("text")}) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""

SQL = {"op1_secret_scan": SECRETS, "op3_ngram_jaccard": JACCARD, "op4_warc": WARC, "op8_embedding_dedup": EMBEDDINGS, "op11_merkle_manifest": MERKLE, "op13_lexical_search": LEXICAL}
