"""Line deduplication by pairwise alignment.

Documents with equal lines (blank ones left out) form a class; all but its first document, by id, lose every
line.  The first ones are aligned in pairs, an earlier with a later one, that share a run of lines: the shortest one
with LEAST_WORDS words from a line, or up to a line, so often that line alone.  Each line of a block that can be deleted lies in a
run within it, so a passage that starts or ends with boilerplate has runs that only its holders have.  A run is rare if at most RARE of the first documents hold it: they
are all aligned with each other.  A run in more documents is boilerplate or a passage that many share: each of
them is aligned with the first one, which holds all of the run, so that pairs grow with the number of lines and
not with the square of a passage's holders.

A pair is aligned by patience diff over both whole line lists: common lines at both ends of a range are matched,
the longest increasing sequence of lines that stand once in either range cuts the rest into ranges, and so on.
Matched lines that follow each other in both documents are a block, and blocks of LEAST_WORDS words or more
are deleted from the later document.  So a lone footer or heading stays, and a passage goes.

Defined results: lines are compared without surrounding white space; blank lines never match, and a blank
line is deleted only between two deleted lines.  Of equally long increasing sequences that counts whose ends
come last.  Null text: no lines, stays null; so does an empty text.  Repeated rows (same id and text) are one
document and get the same edits; rows that share an id but not their text are two documents, in the order of a
hash of their text.  Documents with a null id come last.  A document all of whose lines are deleted keeps an empty
text.  Very long texts are aligned whole.  A column of docs named `_lines_removed` is replaced by the
result; other names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, others, removed, salted_join, slices, tidy, with_flag, written

LEAST_WORDS = 20
RARE = 16
MARKS = "doc long, mark long, at array<int>"
#: A line's hash holds its number of words, up to so many, in its last bits.
COUNTED = 255


def _order(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))


def line_hashes(text: str) -> list[int]:
    """A hash for each line, 0 for a blank one; its last byte is the number of words."""
    out = []
    for line in text.split("\n"):
        words = len(line.split())
        out.append(xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "replace")) >> 1 & ~COUNTED | min(words, COUNTED) if words else 0)
    return out


def _run_ends(lines: list[int]) -> Iterator[tuple[int, int]]:
    """First and end place of the shortest run of LEAST_WORDS words from each line."""
    end, words = 0, 0
    for i, h in enumerate(lines):
        while end < len(lines) and words < LEAST_WORDS:
            words += lines[end] & COUNTED
            end += 1
        if words < LEAST_WORDS:
            return
        yield i, end
        words -= h & COUNTED


def run_keys(lines: list[int]) -> set[int]:
    """A hash for the shortest run of LEAST_WORDS words from each line and for that up to each line (lines: without blank ones)."""
    n = len(lines)
    ends = {*_run_ends(lines), *((n - b, n - a) for a, b in _run_ends(lines[::-1]))}
    return {lines[a] if b == a + 1 else xxhash.xxh3_64_intdigest(np.array(lines[a:b], dtype=np.int64).tobytes()) >> 1 for a, b in ends}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing sequence of distinct values."""
    tops: list[int] = []
    piles: list[int] = []
    back = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def matched_lines(mine: list[int], other: list[int]) -> list[tuple[int, int]]:
    """Places (in mine, in other) of the lines that patience diff matches."""
    out, ranges = [], [(0, len(mine), 0, len(other))]
    while ranges:
        a, b, c, d = ranges.pop()
        while a < b and c < d and mine[a] == other[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(mine[a:b]), Counter(other[c:d])
        place = {h: k for k, h in enumerate(other[c:d], c) if there[h] == 1 == here.get(h)}
        once = [i for i in range(a, b) if mine[i] in place]
        at = [place[mine[i]] for i in once]
        kept = [(once[k], at[k]) for k in increasing(at)]
        out += kept
        for i, j in [*kept, (b, d)] if kept else []:
            ranges.append((a, i, c, j))
            a, c = i + 1, j + 1
    return sorted(out)


def blocks(mine: list[int], other: list[int]) -> list[tuple[int, int]]:
    """First and end places in mine of the aligned blocks with LEAST_WORDS words."""
    out, start, last = [], 0, (-2, -2)
    for i, j in matched_lines(mine, other):
        if (i - 1, j - 1) != last:
            out.append((start, last[0] + 1))
            start = i
        last = i, j
    out.append((start, last[0] + 1))
    return [(a, b) for a, b in out if sum(h & COUNTED for h in mine[a:b]) >= LEAST_WORDS]


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"h": pa.list_(pa.int64()), "at": pa.list_(pa.int32())}
    names = names.split()
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, list(zip(*rows)) or [[]] * len(names))], names)


def _with_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text) -> (doc, mark, h: a hash for each line, c1, c2: which lines there are)."""
    for batch in tidy(slices(batches, "text")):
        rows = []
        for doc, mark, t in zip(*(c.to_pylist() for c in batch.columns)):
            h = line_hashes(t) if t else []
            if any(h):
                c = xxhash.xxh3_128_intdigest(np.array([x for x in h if x], dtype=np.int64).tobytes())
                rows.append((doc, mark, h, (c >> 64) - 2**63, (c & 2**64 - 1) - 2**63))
        yield _batch(rows, "doc mark h c1 c2")


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, h) -> (key, doc, mark)."""
    for batch in slices(batches):
        yield _batch([(k, doc, mark) for doc, mark, h in zip(*(c.to_pylist() for c in batch.columns)) for k in run_keys([x for x in h if x])], "key doc mark")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, h, other): a pair in each row -> (doc, mark, at)."""
    for batch in slices(batches):
        rows = []
        for doc, mark, h, other in zip(*(c.to_pylist() for c in batch.columns)):
            full = [i for i, x in enumerate(h) if x]
            if at := [full[k] for a, b in blocks([h[i] for i in full], [x for x in other if x]) for k in range(a, b)]:
                rows.append((doc, mark, at))
        yield _batch(rows, "doc mark at")


def _pairs(keys: DataFrame) -> DataFrame:
    """(b, b_mark, doc, mark): earlier and later documents to be aligned; keys (key, doc, mark) is materialised."""
    me = F.struct("doc", "mark")
    held = written(keys.groupBy("key").agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "held-runs")
    shared = written(salted_join(keys, held.withColumn("m", F.col("n")), ["key"], "n", keys.count(), me, "inner"), "shared-runs")
    few = shared.where(F.col("m") <= RARE).groupBy("key").agg(F.array_sort(F.collect_list(me)).alias("all"))
    few = few.select("all", F.posexplode("all").alias("k", "later")).select(F.explode(F.slice("all", F.lit(1), F.col("k"))).alias("b"), "later")
    many = shared.where((F.col("m") > RARE) & (F.col("first") < me)).select(F.col("first").alias("b"), me.alias("later"))
    pairs = few.unionByName(many).select(F.col("b.doc").alias("b"), F.col("b.mark").alias("b_mark"), "later.doc", "later.mark").distinct()
    pairs = written(pairs, "pairs")
    removed(held, shared)
    return pairs


def aligned_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, at): line positions to delete from each later document."""
    me = F.struct("doc", "mark")
    base = docs.select(_order(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = written(base.mapInArrow(_with_lists, "doc long, mark long, h array<long>, c1 long, c2 long"), "line-lists")
    same = written(rows.groupBy("c1", "c2").agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-lists")
    classed = written(salted_join(rows, same, ["c1", "c2"], "n", rows.count(), me, "left").drop("c1", "c2"), "lists")
    copies = classed.where(me != F.col("first")).select("doc", "mark", F.expr("filter(transform(h, (x, i) -> if(x = 0, -1, i)), i -> i >= 0)").alias("at")).dropDuplicates(["doc", "mark"])
    firsts = classed.where("first is null").unionByName(classed.where(me == F.col("first")).dropDuplicates(["doc", "mark"])).select("doc", "mark", "h")
    lists = written(firsts, "first-lists")
    keys = written(lists.mapInArrow(_with_keys, "key long, doc long, mark long"), "run-keys")
    pairs = _pairs(keys)
    earlier = pairs.groupBy("b", "b_mark").agg(F.count(F.lit(1)).alias("n"))
    earlier = written(earlier.join(lists.select(F.col("doc").alias("b"), F.col("mark").alias("b_mark"), F.col("h").alias("other")), ["b", "b_mark"]), "earlier-lines")
    both = salted_join(pairs, earlier, ["b", "b_mark"], "n", pairs.count(), me, "inner").join(lists, ["doc", "mark"])
    found = both.select("doc", "mark", "h", "other").mapInArrow(_align, MARKS)
    found = found.groupBy("doc", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    out = written(found.unionByName(copies), "line-marks")
    removed(rows, same, classed, lists, keys, pairs, earlier)
    return out


def _without(text: pd.Series, at: pd.Series) -> pd.DataFrame:
    out, removed = [], []
    for t, gone in zip(text, at):
        if t is None:
            out.append(None)
            removed.append(0)
            continue
        gone, kept, blank, inside = set(gone.tolist()), [], [], False
        for i, line in enumerate(t.split("\n")):
            if i in gone:
                blank, inside = blank if not inside else [], True
                kept += blank
                blank = []
            elif inside and not line.strip():
                blank.append(line)
            else:
                kept += [*blank, line]
                blank, inside = [], False
        out.append("\n".join(kept + blank))
        removed.append(len(gone))
    return pd.DataFrame({"text": out, "removed": removed})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the edited text, and _lines_removed.  Texts that nothing is deleted from are not shuffled."""
    without = F.pandas_udf(_without, "text string, removed int")
    doc, mark, at, new, n = (free_name(docs, c) for c in ("_doc", "_mark", "_at", "_new", "_n"))
    keyed = docs.withColumn(doc, _order(id_col)).withColumn(mark, F.xxhash64(text_col))
    edits = aligned_lines(docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("at").alias(at))
    edited = free_name(keyed, "_edited")
    keyed = with_flag(keyed, F.xxhash64(doc, mark), edits.select(F.xxhash64(doc, mark).alias("hash")), "hash", edited)
    passed = others(docs, "_lines_removed")
    whole = keyed.where(~F.col(edited)).select(*passed, F.lit(0).alias("_lines_removed"))
    some = keyed.where(edited).drop(edited)
    # how often each of these documents is repeated, so that one that fills many rows is dealt over several tasks
    times = written(some.groupBy(doc, mark).agg(F.count(F.lit(1)).alias(n)).join(edits, [doc, mark], "left"), "edits")
    joined = salted_join(some, times, [doc, mark], n, times.agg(F.sum(n)).first()[0] or 0, F.monotonically_increasing_id())
    joined = joined.withColumn(new, without(F.when(F.col(at).isNotNull(), F.col(text_col)), at))
    text = F.when(F.col(at).isNotNull(), F.col(new)["text"]).otherwise(F.col(text_col))
    return whole.unionByName(joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in passed), F.coalesce(F.col(new)["removed"], F.lit(0)).alias("_lines_removed")))
