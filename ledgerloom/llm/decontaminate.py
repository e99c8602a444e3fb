"""Benchmark decontamination by spaced seeds.

Fixed masks pick some token positions of a window and ignore the others, so a window still hits when words
at ignored positions were replaced.  The hashes of all masked windows of the benchmark are written as a table.
The documents are scanned: a window that is not in a bitmap of these hashes (of fixed size, whatever the
benchmark's) cannot hit, and a document none of whose windows is in it is clean.  The windows that are left (the words of
their documents beside them) are joined
with the table by hash, and each hit is verified: along the hit's diagonal, item and document are compared word by
word, and the longest stretch of which at least 0.8 are equal words is an overlap if it has MIN_WORDS words, or
the whole item's if that is shorter.  Overlaps of an item that touch or lie over each other are one.
Items with fewer words are sought by masks of their whole length: the item is cut into two parts more than words may
be replaced, and each mask leaves out as many parts as that, so one mask leaves out all that hold a replaced word.

Neighbouring windows with the same hash (one word over and over) are one row with a first and a last place,
so a pair of such passages is one hit with a range of diagonals.  Frequent hashes and items are dealt over several
tasks; only the bitmap and the list of short items' lengths pass through the driver.

Defined results: null or empty texts and items have no overlap; a null item id is skipped; repeated
documents get equal results; repeated items count by id; a stretch of exactly 0.8 equal words counts; of equally
long stretches of a diagonal the first counts; an empty benchmark leaves every document clean and an empty table of
documents gives no rows; very long texts are scanned whole.  A column of docs that is named `overlaps` is
replaced by the result; other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, bitmap_of, free_name, others, removed, salted_join, slices, tidy, with_flag, written
from .words import MIX, hashes_of, mixed, windows

MIN_WORDS = 13
#: Fixed masks: whichever words of a stretch of MIN_WORDS or more are replaced, if 0.8 are equal, at least one of these hits in it.
#: (From 28 words on, either the first 15 have 0.8 equal words or the rest has; shorter stretches are enumerated in the tests.)
MASKS = ("11101011", "1100000001111", "1110100011")
#: Equal words that make up for a replaced one: four mean that 0.8 of a stretch are equal.
REPLACED_COSTS = 4
OVERLAPS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("identity", T.DoubleType())]))
_ARROW_OVERLAPS = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("identity", pa.float64())]))
_ARROW_HITS = pa.list_(pa.struct([("hash", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))


def item_masks(n: int) -> list[tuple[int, ...]]:
    """Positions of the masks for an item of n words, fewer than MIN_WORDS: one hits whichever words are replaced, if 0.8 are equal."""
    k = n // (REPLACED_COSTS + 1)
    parts = [range(n * i // (k + 2), n * (i + 1) // (k + 2)) for i in range(k + 2)] if k else [range(n)]
    return [tuple(p for part in kept for p in part) for kept in combinations(parts, len(parts) - k)]


Mask = tuple[int, tuple[int, ...], int, int]


def all_masks(short: list[int]) -> list[Mask]:
    """(number, positions, least and greatest number of words of an item that they are for)."""
    long = [(tuple(p for p, c in enumerate(m) if c == "1"), MIN_WORDS, 2**62) for m in MASKS]
    return [(k, *m) for k, m in enumerate(long + [(m, n, n) for n in short for m in item_masks(n)])]


def seed_runs(words: np.ndarray, left: np.ndarray, masks: list[Mask], keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last place) of the windows of all masks; neighbours with the same hash are one.

    left: for each word how many words its text has from there on; keep: which hashes count (all).
    """
    out = []
    for k, positions, _, _ in masks:
        h = mixed(windows(words, positions) + np.uint64(k) * MIX)  # each mask has hashes of its own
        ok = left[: len(h)] > positions[-1]
        at = np.flatnonzero(ok if keep is None else ok & keep(h))
        new = np.ones(len(at), dtype=bool)
        # a run ends at the end of a text
        new[1:] = (np.diff(at) != 1) | (h[at[1:]] != h[at[:-1]]) | (left[at[1:]] != left[at[:-1]] - 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
        out.append((h[at[first]], at[first], at[last]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _left(ends: np.ndarray) -> np.ndarray:
    return np.repeat(ends[1:], np.diff(ends)) - np.arange(ends[-1])


def overlap_ranges(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, float]]:
    """(first word, end word, greatest share of equal words) of the parts of doc that overlap with item."""
    found = []
    for d in diagonals.tolist():
        start, end = max(0, d), min(len(doc), d + len(item))
        equal = doc[start:end] == item[start - d : end - d]
        # the longest stretch whose equal words pay for its replaced ones: each pays for a quarter of one
        total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -REPLACED_COSTS))])
        first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
        b = int((np.arange(len(total)) - first).argmax())
        a = int(first[b])
        if b - a >= min(MIN_WORDS, len(item)):
            found.append((start + a, start + b, float(equal[a:b].mean())))
    out: list[tuple[int, int, float]] = []
    for a, b, share in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(share, out[-1][2]))
        else:
            out.append((a, b, share))
    return out


def _item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, ik, n, words): ik names an item's text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "text")):
            w, ends = hashes_of(b.column("text").to_pylist())
            rows = [w[a:c] for a, c in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("ik"), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["item", "ik", "n", "words"])

    base = items.select(F.col(id_col).cast("long").alias("item"), F.xxhash64(id_col, text_col).alias("ik"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    return base.mapInArrow(split, "item long, ik long, n long, words binary").where("n > 0").dropDuplicates(["item", "ik"])


def _seeds(items: DataFrame, masks: list[Mask]) -> DataFrame:
    """(hash, ik, q_lo, q_hi) of the items' windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = [[], [], [], []]
            for ik, n, raw in zip(*(b.column(c).to_pylist() for c in ("ik", "n", "words"))):
                w = np.frombuffer(raw, dtype=np.uint64)
                h, lo, hi = seed_runs(w, n - np.arange(n), [m for m in masks if m[2] <= n <= m[3]])
                for col, x in zip(cols, (h.view(np.int64), np.full(len(h), ik), lo, hi)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0)]).astype(np.int64)) for c in cols], ["hash", "ik", "q_lo", "q_hi"])

    return items.mapInArrow(cut, "hash long, ik long, q_lo long, q_hi long")


def _scan(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, masks: list[Mask]) -> DataFrame:
    """(k1, k2, words, hits) of the documents that have hits; k1 and k2 name id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = lambda h: among(shared.value, h)
        for b in tidy(slices(batches, "text")):
            w, ends = hashes_of(b.column("text").to_pylist())
            h, lo, hi = seed_runs(w, _left(ends), masks, keep)
            doc = np.searchsorted(ends, lo, "right") - 1
            found: dict[int, list] = {}
            for i, x, p, q in zip(doc.tolist(), h.view(np.int64).tolist(), (lo - ends[doc]).tolist(), (hi - ends[doc]).tolist()):
                found.setdefault(i, []).append({"hash": x, "lo": p, "hi": q})
            at = pa.array(list(found), pa.int64())
            own_words = [w[ends[i] : ends[i + 1]].tobytes() for i in found]
            yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array(own_words, pa.binary()), pa.array(list(found.values()), _ARROW_HITS)], ["k1", "k2", "words", "hits"])

    keyed = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    return keyed.mapInArrow(find, "k1 long, k2 long, words binary, hits array<struct<hash: long, lo: long, hi: long>>")


def _keys(id_col: str, text_col: str, k1: str = "k1", k2: str = "k2") -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias(k1), F.xxhash64(text_col, id_col).alias(k2)]


def _verified(pairs: DataFrame) -> DataFrame:
    """(k1, k2, overlaps) of pairs (k1, k2, item, doc_words, item_words, diagonals: ranges)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "doc_words"):
            out = []
            for item, dw, iw, ranges in zip(*(b.column(c).to_pylist() for c in ("item", "doc_words", "item_words", "diagonals"))):
                diagonals = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges]))
                found = overlap_ranges(np.frombuffer(dw, dtype=np.uint64), np.frombuffer(iw, dtype=np.uint64), diagonals)
                out.append([{"item": item, "start": a, "end": e, "identity": share} for a, e, share in found])
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(out, _ARROW_OVERLAPS)], ["k1", "k2", "overlaps"])

    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("overlaps", OVERLAPS)])
    found = pairs.mapInArrow(compare, schema).where(F.size("overlaps") > 0)
    return found.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("overlaps")))).alias("overlaps"))


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", passed: list[str] | None = None) -> DataFrame:
    """docs' columns `passed` (by default all but one named so) and `overlaps`: array of (item, start, end, identity), in words."""
    passed = others(docs, "overlaps") if passed is None else passed
    bench = written(_item_words(items, item_id, item_text), "bench-items")
    masks = all_masks(sorted(r.n for r in bench.where(F.col("n") < MIN_WORDS).select("n").distinct().collect()))
    seeds = written(_seeds(bench, masks), "bench-seeds")
    scanned = written(_scan(docs, id_col, text_col, bitmap_of(seeds, "hash"), masks), "bench-scan")
    doubtful = scanned.groupBy("k1", "k2").agg(F.any_value("words").alias("doc_words"), F.any_value("hits").alias("hits"), F.count(F.lit(1)).alias("rows"))
    doubtful = written(doubtful, "bench-doubtful")

    places = doubtful.select("k1", "k2", F.inline("hits"))
    met = written(seeds.join(places.groupBy("hash").agg(F.count(F.lit(1)).alias("times")), "hash"), "bench-met")
    total = met.select("hash", "times").distinct().agg(F.sum("times")).first()[0] or 0
    diagonal = F.struct((F.col("lo") - F.col("q_hi")).alias("lo"), (F.col("hi") - F.col("q_lo")).alias("hi"))
    pairs = salted_join(places, met, ["hash"], "times", total, F.col("k1"), "inner").groupBy("k1", "k2", "ik").agg(F.collect_set(diagonal).alias("diagonals"))
    pairs = written(pairs, "bench-pairs")
    asked = pairs.groupBy("ik").agg(F.count(F.lit(1)).alias("times"))
    asked = written(bench.select("item", "ik", F.col("words").alias("item_words")).join(asked, "ik"), "bench-asked")
    both = salted_join(pairs, asked, ["ik"], "times", pairs.count(), F.col("k1"), "inner").join(doubtful.select("k1", "k2", "doc_words"), ["k1", "k2"])
    found = _verified(both).join(doubtful.select("k1", "k2", "rows"), ["k1", "k2"])
    found = written(found, "bench-overlaps")
    removed(bench, seeds, scanned, doubtful, met, pairs, asked)
    # documents are read once more; only those that may have an overlap are joined
    k1, k2, flag, n, own = (free_name(docs, c) for c in ("_k1", "_k2", "_flag", "_rows", "_overlaps"))
    keyed = with_flag(docs.select(*(F.col(f"`{c}`").alias(f"_passed{i}") for i, c in enumerate(passed)), *_keys(id_col, text_col, k1, k2)), F.col(k1), found, "k1", flag)
    none = F.array().cast(OVERLAPS)
    back = [F.col(f"_passed{i}").alias(c) for i, c in enumerate(passed)]
    clean = keyed.where(~F.col(flag)).select(*back, none.alias("overlaps"))
    small = found.withColumnsRenamed({"k1": k1, "k2": k2, "overlaps": own, "rows": n})
    joined = salted_join(keyed.where(flag), small, [k1, k2], n, found.agg(F.sum("rows")).first()[0] or 0, F.monotonically_increasing_id())
    return clean.unionByName(joined.select(*back, F.coalesce(own, none).alias("overlaps")))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document: whether it is contaminated, by which items, and where."""
    found = find_overlaps(docs, items, passed=["doc_id"])
    ids = F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item"])))
    spans = F.transform("overlaps", lambda o: F.concat_ws(":", o["item"].cast("string"), o["start"].cast("string"), o["end"].cast("string")))
    return found.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("items"), F.array_join(spans, ",").alias("spans"), F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["identity"])), F.lit(0.0)).alias("best_identity"))
