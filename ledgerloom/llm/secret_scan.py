"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: an OR of clauses, each an AND of
trigrams that every match must hold.  The index keeps postings (trigram, document) for the trigrams that
any query asks for, is intersected per clause, and only documents that pass are verified by the expression
itself, over the whole text.  A rule without a mandatory trigram (a bare hex run) scans every document.
Which rules a document passed is brought to its text: by broadcast if at most SMALL documents passed any, so
that no text is shuffled, else by a join that deals rows of one key over several tasks.

Defined results: a null text counts as empty and has no span; repeated rows are scanned alike and each
keeps its own result, as do rows that share an id only; a null doc_id is an ordinary one; spans that start together
come in the order of their rules; a very long text is scanned whole; other columns of docs, whatever their
names, are not read; an empty table gives an empty result.  Positions are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share; group `group` of a match needs `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the contract's rules, the rest are added by this operator.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 or more characters
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
MOST_STRINGS = 64
#: Documents (two longs and an int each) of which the list may be broadcast.
SMALL = 200_000


def _runs(nodes) -> list[set[str] | None]:
    """The expression as a sequence of exact string sets, with None where text is not fixed."""
    out: list[set[str] | None] = []
    for op, arg in nodes:
        if op is K.LITERAL:
            out.append({chr(arg)})
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            out.append({chr(a) for _, a in arg})
        elif op is K.SUBPATTERN:
            out.extend(_runs(arg[3]))
        elif op is K.BRANCH:
            branches = [_joined(_runs(b)) for b in arg[1]]
            whole = all(len(b) == 1 and b[0] is not None for b in branches)
            out.append(set().union(*(b[0] for b in branches)) if whole else None)
        elif op is K.MAX_REPEAT and arg[0] == arg[1] <= 8:
            out.extend(_runs(arg[2]) * arg[0])
        elif op is K.MAX_REPEAT and tuple(arg[:2]) == (0, 1):
            inner = _joined(_runs(arg[2]))
            out.append({""} | inner[0] if len(inner) == 1 and inner[0] is not None else None)
        elif op is K.AT:
            continue
        else:
            out.append(None)
    return out


def _joined(runs: list[set[str] | None]) -> list[set[str] | None]:
    """Neighbouring string sets multiplied out while they stay small."""
    out: list[set[str] | None] = []
    for r in runs:
        if r is not None and out and out[-1] is not None and len(r) * len(out[-1]) <= MOST_STRINGS:
            out[-1] = {a + b for a, b in product(out[-1], r)}
        else:
            out.append(r)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams, one of which must hold; empty when no trigram is mandatory."""
    sets = [s for s in _joined(_runs(_parser.parse(pattern))) if s is not None and min(map(len, s)) >= 3]
    if not sets:
        return []
    best = max(sets, key=lambda s: (min(map(len, s)), -len(s)))
    return sorted({frozenset(w[i : i + 3].lower() for i in range(len(w) - 2)) for w in best}, key=sorted)


def _index_pattern(trigrams: list[str]) -> str:
    """Finds every overlapping trigram of the list; grouped by first character so that most positions fail at once."""
    quote = lambda s: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in s)
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(f"{quote(a)}(?:{'|'.join(map(quote, rest))})" for a, rest in sorted(by_first.items())) + "))"


def build_index(docs: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """Postings (key, trigram) of all trigrams that the rules' queries use."""
    trigrams = sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})
    if not trigrams:
        return docs.select(key, F.lit("").alias("trigram")).limit(0)
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_index_pattern(trigrams)), F.lit(1)))
    return docs.select(key, F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, key: str, rules=RULES) -> DataFrame:
    """(key, rules, times): a bit for each rule one of whose clauses is wholly present; times: rows of the key."""
    clauses = [(i, sorted(c)) for i, r in enumerate(rules) for c in trigram_query(r.pattern)]
    uses: dict[str, list[tuple[int, int]]] = {}
    for n, (_, c) in enumerate(clauses):
        for bit, t in enumerate(c):
            uses.setdefault(t, []).append((n, 1 << bit))
    pairs = {t: F.array(*(F.struct(F.lit(n).alias("clause"), F.lit(b).cast("long").alias("bit")) for n, b in u)) for t, u in uses.items()}
    lookup = F.create_map(*(x for t, a in sorted(pairs.items()) for x in (F.lit(t), a)))
    full = F.array(*(F.lit((1 << len(c)) - 1).cast("long") for _, c in clauses))
    rule_of = F.array(*(F.lit(1 << i) for i, _ in clauses))
    hits = postings.select(key, F.explode(lookup[F.col("trigram")]).alias("u")).groupBy(key, F.col("u.clause").alias("clause")).agg(F.bit_or("u.bit").alias("bits"), F.count(F.lit(1)).alias("uses"))
    # a row of the key uses each of the clause's trigrams once
    full_ones = hits.where(F.col("bits") == full[F.col("clause")]).withColumn("times", F.expr("uses div bit_count(bits)"))
    return full_ones.groupBy(key).agg(F.bit_or(rule_of[F.col("clause")]).alias("rules"), F.max("times").alias("times"))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, i: int, rule: Rule) -> Column:
    """Array of (start, kind, end): the lengths between and of the matches, summed up."""
    pat = F.lit(rule.pattern)
    gaps, found, value = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pat, F.lit(0)), F.regexp_extract_all(text, pat, F.lit(rule.group))
    rows = F.zip_with(F.transform(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), F.length), F.transform(F.arrays_zip(found.alias("m"), value.alias("v")), lambda x: F.struct(F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v"))), lambda g, m: F.struct(g.alias("g"), m["m"].alias("m"), m["v"].alias("v")))
    kind = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["m"]).alias("at"),
        F.when(x["v"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), F.lit(i).alias("kind"), (acc["at"] + x["g"] + x["m"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    walk = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), kind.alias("out")), step, lambda acc: acc["out"])
    long = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["g"] + x["m"])
    # appending to an array copies it, so about sqrt(n) parts of sqrt(n) matches are walked through, each from where it begins
    wide = lambda r: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(r))).cast("int"))
    parts = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(r) - 1) / wide(r)).cast("int"))), lambda k: F.slice(r, k * wide(r) + 1, wide(r)))
    none = F.array().cast("array<int>")
    begins = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, p: F.struct((acc["at"] + long(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    spans = _once(_once(rows, parts), lambda ps: F.flatten(F.zip_with(ps, begins(ps), walk)))
    return F.when(text.rlike(rule.pattern), spans).otherwise(kind)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """docs' rows as (id, text, spans): all matches of all rules, by start and then by rule order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_key"), text.alias("_text"))
    passed = written(candidates(build_index(base, "_key", "_text", rules), "_key", rules), "secret-candidates")
    n, total = passed.agg(F.count(F.lit(1)), F.sum("times")).first()
    joined = base.join(F.broadcast(passed), "_key", "left") if n <= SMALL else salted_join(base, passed, ["_key"], "times", total, F.monotonically_increasing_id())
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = [_spans(F.col("_text"), i, r) if not trigram_query(r.pattern) else F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << i) != 0, _spans(F.col("_text"), i, r)).otherwise(none) for i, r in enumerate(rules)]
    return joined.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.array_sort(F.concat(*each)).alias("spans"))


def span_text(spans: Column, rules=RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """The contract's columns for scan_secrets' result."""
    kinds = {r.kind: i for i, r in enumerate(rules)}
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == kinds[k])).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return scanned.select(id_col, *(count(k) for k in BASE), F.sha2(span_text(base, rules).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans"), rules).alias("spans"))
