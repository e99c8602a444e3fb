"""Overlaps against brute force, at the very threshold, and for items of every short length."""

import itertools
import random
import re

import numpy as np
from ledgerloom.llm import decontaminate
from pyspark.sql import functions as F


def patterns(n):
    """A row for each way to replace as many of n words as leave 0.8 equal."""
    ways = list(itertools.combinations(range(n), n // 5))
    bad = np.array(ways, dtype=int).reshape(len(ways), n // 5)
    out = np.zeros((len(bad), n), dtype=bool)
    out[np.arange(len(bad))[:, None], bad] = True
    return out


def test_masks_meet_every_pattern():
    for n in range(13, 28):
        left = patterns(n)
        for m in decontaminate.MASKS:
            at = np.array([p for p, c in enumerate(m) if c == "1"])
            for s in range(n - len(m) + 1):
                left = left[left[:, at + s].any(axis=1)]
        assert not len(left), n


def test_item_masks_meet_every_pattern():
    for n in range(1, decontaminate.MIN_WORDS):
        left = patterns(n)
        for m in decontaminate.item_masks(n):
            left = left[left[:, list(m)].any(axis=1)]
        assert not len(left), n


def reported(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.report(d.repartition(3), b).collect()}


def test_overlaps_of_exactly_the_least_share(spark):
    rng = random.Random(31)
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(1, 31)}
    docs, want = [], {}
    for n, w in items.items():
        ways = list(itertools.combinations(range(n), n // 5))
        for bad in rng.sample(ways, min(len(ways), 60)):
            want[len(docs)] = str(n)
            docs.append((len(docs), " ".join(["a", "b", *("zzz" if i in bad else x for i, x in enumerate(w)), "c"])))
        worse = {0, *range(n - n // 5, n)} if n < 13 else set()
        if worse:  # one word more
            docs.append((len(docs), " ".join("zzz" if i in worse else x for i, x in enumerate(w))))
    got = reported(spark, docs, [(n, " ".join(w)) for n, w in items.items()])
    # a longest stretch may leave out replaced words at the ends
    assert {i: r["items"] for i, r in got.items() if r.contaminated} == want and all(r.best_identity >= 0.8 for r in got.values() if r.contaminated)


def brute(doc, item):
    """Spans of doc: on every diagonal the longest stretch (of equal ones the first) with enough equal words, put together."""
    d, w = (re.findall(r"\w+", (t or "").lower()) for t in (doc, item))
    need, cover = min(decontaminate.MIN_WORDS, len(w)), set()
    for k in range(-len(w) + 1, len(d) if w else 0):
        a, b = max(0, k), min(len(d), k + len(w))
        best = None
        for x, y in itertools.combinations(range(a, b + 1), 2):
            if y - x >= need and 5 * sum(d[i] == w[i - k] for i in range(x, y)) >= 4 * (y - x) and (best is None or y - x > best[1] - best[0]):
                best = x, y
        if best:
            cover |= {(i, i + 1) for i in range(*best)}
    out = []
    for a, b in sorted(cover):
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_spans_equal_brute_force(spark):
    rng = random.Random(32)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 7, 12, 13, 20, 31])))) for i in range(14)]
    items += [(20, "la " * 17), (21, "la la la lo " * 6), (22, None), (None, words[0]), (23, ""), (3, items[4][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        docs.append((i, " ".join(w)))
    docs += [(90, "la " * 40), (91, "x " + "la " * 15 + "lo la"), (92, None), (93, ""), (94, "la la la lo " * 3)]
    got = reported(spark, docs, items)
    for i, t in docs:
        want = sorted({(k, a, b) for k, item in items if k is not None for a, b in brute(t, item)})
        assert [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",") if s] == want, (i, t)


def test_repeated_words_stay_cheap(spark):
    got = reported(spark, [(1, "la " * 60_000), (2, "lo " * 60_000)], [(1, "la " * 400)])
    assert got[1].spans == "1:0:60000" and got[2].spans == ""


def test_frequent_items_are_dealt_out(spark, monkeypatch):
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"own{i} {passage}") for i in range(50)] + [(7, f"own7 {passage}")] * 20 + [(99, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("overlaps", "_k1", "_hits", "_rows", "hash", "k1", "_overlaps")})
    out = decontaminate.find_overlaps(d, spark.createDataFrame([(1, passage), (2, passage)], "item_id long, text string"))
    rows = out.collect()
    assert len(rows) == 71 and out.columns == [c for c in d.columns if c != "overlaps"] + ["overlaps"]
    assert all([(o["item"], o.start, o.end) for o in r.overlaps] == ([] if r.doc_id == 99 else [(1, 1, 31), (2, 1, 31)]) for r in rows)
