"""Line deduplication against an independent version on lists of strings."""

import collections
import itertools
import random

import pytest
from ledgerloom.llm import line_dedup
from pyspark.sql import functions as F


def longest(at):
    """Places of a longest increasing sequence, by its definition; among equal ones, whose ends come last."""
    best = []
    for i, y in enumerate(at):
        before = [j for j in range(i) if at[j] < y]
        most = max((best[j][0] for j in before), default=0)
        best.append((most + 1, max((j for j in before if best[j][0] == most), default=None)))
    i = max((i for i in range(len(at)) if best[i][0] == max(b[0] for b in best)), default=None)
    out = []
    while i is not None:
        out, i = [i, *out], best[i][1]
    return out


def patience(a, b, i=0, j=0):
    """Pairs of places that a patience diff matches."""
    if not a or not b:
        return set()
    if a[0] == b[0]:
        return {(i, j)} | patience(a[1:], b[1:], i + 1, j + 1)
    if a[-1] == b[-1]:
        return {(i + len(a) - 1, j + len(b) - 1)} | patience(a[:-1], b[:-1], i, j)
    once = [s for s in a if a.count(s) == b.count(s) == 1]
    kept = [once[k] for k in longest([b.index(s) for s in once])]
    out, x, y = set(), 0, 0
    for s in kept:
        p, q = a.index(s), b.index(s)
        out |= {(i + p, j + q)} | patience(a[x:p], b[y:q], i + x, j + y)
        x, y = p + 1, q + 1
    return out | patience(a[x:], b[y:], i + x, j + y) if kept else out


def words(lines):
    return sum(min(len(s.split()), 255) for s in lines)


def runs(lines):
    out = set()
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            enough = words(lines[i:j]) >= line_dedup.LEAST_WORDS
            if enough and (words(lines[i : j - 1]) < line_dedup.LEAST_WORDS or words(lines[i + 1 : j]) < line_dedup.LEAST_WORDS):
                out.add(tuple(lines[i:j]))
    return out


def brute(docs, every_pair=False):
    """(id, text) with distinct ids -> the lines that stay, blank ones left out; every_pair: of documents that share a run, however frequent."""
    lines = {i: [s.strip() for s in t.split("\n") if s.strip()] for i, t in sorted(docs)}
    first = {}
    for i, x in lines.items():
        first.setdefault(tuple(x), i)
    holders = collections.defaultdict(list)
    for i, x in lines.items():
        if first[tuple(x)] == i:
            for r in runs(x):
                holders[r].append(i)
    pairs = set()
    for h in holders.values():
        pairs |= set(itertools.combinations(h, 2)) if every_pair or len(h) <= line_dedup.RARE else {(h[0], i) for i in h[1:]}
    gone = {i: set(range(len(x))) if x and first[tuple(x)] != i else set() for i, x in lines.items()}
    for e, i in pairs:
        same = patience(lines[i], lines[e])
        for p, q in same:
            if (p - 1, q - 1) not in same:  # a block starts
                n = next(n for n in itertools.count() if (p + n, q + n) not in same)
                if words(lines[i][p : p + n]) >= line_dedup.LEAST_WORDS:
                    gone[i] |= set(range(p, p + n))
    return {i: [s for p, s in enumerate(x) if p not in gone[i]] for i, x in lines.items()}


def deduplicated(spark, docs):
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    return {r.doc_id: [s.strip() for s in r.text.split("\n") if s.strip()] for r in out}


def line(name, n=25):
    return " ".join(f"{name}{k}" for k in range(n))


A, B, C, R = line("a"), line("b"), line("c"), line("r")


def test_copies_lose_repeated_and_short_lines(spark):
    texts = [f"{A}\n{R}\n{B}\n{R}\n{C}", "x\nx\ny\ny", "menu\nhome", f"menu\n{A} 4", f"home\n{A} 5"]
    docs = list(enumerate(texts)) + [(10 + i, t + "\n") for i, t in enumerate(texts)]
    assert deduplicated(spark, docs) == brute(docs)
    assert not any(deduplicated(spark, docs)[10 + i] for i in range(len(texts)))


def test_unrelated_documents_keep_a_shared_footer(spark):
    docs = [(i, f"{line(f'p{i}x')}\n{line(f'q{i}x')}\nAll rights reserved by the owner of this site") for i in range(40)]
    assert deduplicated(spark, docs) == {i: t.split("\n") for i, t in docs}


def test_a_footer_goes_with_the_passage_before_it(spark):
    docs = [(i, f"{line(f'p{i}x')}\n{A}\nAll rights reserved") for i in range(3)]
    assert deduplicated(spark, docs) == {0: docs[0][1].split("\n"), 1: [line("p1x")], 2: [line("p2x")]}


def test_documents_are_aligned_with_others_than_first_holders(spark):
    docs = [(1, f"{C}\n{B}\n{A}"), (2, f"{A}\n{B}\n{C}\nown line of the second"), (3, f"{A}\n{B}\n{C}\nown line of the third")]
    assert deduplicated(spark, docs)[3] == ["own line of the third"]
    assert deduplicated(spark, docs) == brute(docs)


def test_equals_the_independent_version(spark, monkeypatch):
    rng = random.Random(30)
    pool = [f"line {i}" + " and more of it" * rng.randrange(9) for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool[: rng.choice([6, 12, 40])]) for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    for i in range(60):  # changed copies: moved, repeated and dropped lines
        t = docs[rng.randrange(150)][1].split("\n")
        for _ in range(rng.randrange(4)):
            t.insert(rng.randrange(len(t) + 1), rng.choice([rng.choice(t), rng.choice(pool), t.pop(rng.randrange(len(t))) if len(t) > 1 else "", ""]))
        docs.append((200 + i, "\n".join(t)))
    for rare in (3, 16, 1000):  # with runs in more documents than that, and without
        monkeypatch.setattr(line_dedup, "RARE", rare)
        assert deduplicated(spark, docs) == brute(docs)


@pytest.mark.parametrize("holders", [8, 17, 30, 3000])
def test_a_short_passage_beside_boilerplate_goes_however_many_hold_that(spark, holders):
    x, y = "short passage after it", "and one before it"
    docs = [(i, f"{line(f'p{i}x')}\n{R}\n{line(f'q{i}x')}") for i in range(holders - 4)]
    docs += [(5000 + i, f"{line(f's{i}x')}\n{R}\n{x}\nyet more\n{line(f't{i}x')}") for i in range(2)]
    docs += [(6000 + i, f"{line(f'u{i}x')}\n{y}\n{R}\n{line(f'v{i}x')}") for i in range(2)]
    got = deduplicated(spark, docs)
    assert got[5000] == [line("s0x"), x, "yet more", line("t0x")] and got[5001] == [line("s1x"), line("t1x")]
    assert got[6000] == [line("u0x"), y, line("v0x")] and got[6001] == [line("u1x"), line("v1x")]


def test_equals_alignment_of_every_pair_where_passages_keep_their_order(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{i}k{k}" for k in range(rng.choice([3, 9, 21]))) for i in range(30)]  # any line precedes those of larger index
    docs = []
    for i in range(90):
        own = iter(range(100))
        lines = []
        for k in sorted(rng.sample(range(30), 3)):
            lines += [f"own {i} {next(own)}", *pool[k : k + rng.randrange(1, 6)]]
        docs.append((i, "\n".join(dict.fromkeys(lines))))
    assert deduplicated(spark, docs) == brute(docs, every_pair=True)


def test_repeated_ids_and_rows(spark):
    docs = [(1, f"{A}\n{B}")] * 3 + [(1, f"{A}\n{C}"), (None, f"{B}\nx"), (None, None), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_lines_removed", F.lit("clash"))
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_lines_removed"] and got.count() == len(docs)
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert texts.count((1, f"{A}\n{B}")) in (3, 0) and (None, "x") in texts and (None, None) in texts and (2, "") in texts
    whole = [t for _, t in texts if t and A in t]
    assert len(whole) in (1, 3)  # one of the two documents of id 1 keeps the line, in all its rows
