"""Minimax contiguous partition of ordered atomic groups into k shards.

Groups of equal texts stay together; they are ordered by their digest, so a row finds its shard by
comparing its own digest with k - 1 cuts and no join is needed.  The smallest feasible capacity is found by
binary search with a greedy check.  The check runs on block sums: digest prefixes, at most 4,096 at first.
Only blocks in which a cut can fall are split further (by two more digits), until the capacity and the cuts
are exact, so the driver holds a bounded number of sums however many groups there are.

Defined results: a null text has size 1 and the digest '' (all null texts are one group, which comes first; the empty
text is another group); repeated rows are rows of the same group; an empty table gives no rows; a group larger than
a fair share fills a shard alone, and shards may then stay empty; of capacities the smallest is taken, so there are no
ties; rows of a shard are numbered in any order; a very long text counts with all its bytes; other columns of docs, whatever
their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Slots are numbered in buckets of about so many rows.
SLOT_ROWS = 1_000_000


def _greedy(ends: list[int], atomic: list[bool], cap: int, k: int, hopeful: bool) -> tuple[list[int], bool]:
    """Cut positions of k shards of at most cap, as far as they come, and whether they hold all.

    hopeful: a block that is not split yet may be cut anywhere; else only between blocks.
    """
    at, cuts, total = 0, [], ends[-1]
    while total - at > cap:
        j = bisect_right(ends, at + cap)
        to = at + cap if hopeful and not atomic[j] else (ends[j - 1] if j else 0)
        if to <= at or len(cuts) == k - 1:
            return cuts, False
        cuts.append(at := to)
    return cuts, True


def _smallest(ends, atomic, least, k, hopeful) -> int:
    lo, hi = least, ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _greedy(ends, atomic, mid, k, hopeful)[1] else (mid + 1, hi)
    return lo


def minimax_cuts(groups: DataFrame, k: int, digest: str = "digest", size: str = "size") -> list[str]:
    """First digest prefixes of shards 2.. for groups (digest, size); rows with digest >= a cut lie behind it."""

    def sums(digits: int, within: list[str] | None) -> list[tuple[str, int, int, int]]:
        g = groups if within is None else groups.where(F.substring(digest, 1, len(within[0])).isin(within))
        rows = g.groupBy(F.substring(digest, 1, digits).alias("p")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n"), F.max(size).alias("m")).collect()
        return sorted((r.p, int(r.s), int(r.n), int(r.m)) for r in rows)

    blocks = sums(FIRST_DIGITS, None)
    if not blocks:
        return []
    total, largest = sum(b[1] for b in blocks), max(b[3] for b in blocks)
    least = max(-(-total // k), largest)
    while True:
        ends, atomic = list(accumulate(b[1] for b in blocks)), [b[2] == 1 for b in blocks]
        lo, hi = (_smallest(ends, atomic, least, k, hopeful) for hopeful in (True, False))
        early, late = _greedy(ends, atomic, lo, k, False)[0], _greedy(ends, atomic, hi, k, True)[0]
        if lo == hi and early == late:
            return [blocks[bisect_right(ends, c)][0] for c in late]
        # the exact cuts lie between those of the cautious check at lo and of the hopeful one at hi
        late += [total] * (k - 1 - len(late))
        early += [early[-1] if early else 0] * (k - 1 - len(early))
        starts = [0, *ends[:-1]]
        split = [b[0] for b, s, e, a in zip(blocks, starts, ends, atomic) if not a and any(s <= h and e >= w for w, h in zip(early, late))]
        kept = [b for b in blocks if b[0] not in set(split)]
        for digits in sorted({len(p) for p in split}):
            kept += sums(digits + MORE_DIGITS, [p for p in split if len(p) == digits])
        blocks = sorted(kept)


def shard_rows(docs: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, digest, shard, slot): slot counts from 0 without gaps in each shard."""
    t = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(t.cast("binary")), F.lit("")).alias("digest"),
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("_draw"),  # written, so it stays the same
    )
    slim = written(slim, "shard-rows")
    groups = written(slim.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    cuts = minimax_cuts(groups, k)
    total = groups.agg(F.sum("n")).first()[0] or 0
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("digest") >= F.lit(c)).cast("int")
    width = max(1, total // min(SLOT_ROWS, max(500, total // 512)))
    rows = slim.withColumn("shard", shard).withColumn("_b", F.pmod("_draw", F.lit(width)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_draw", "_id", "digest")))
    out = numbered.join(offsets, ["shard", "_b"])
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "digest", "shard", (F.col("_before") + F.col("_r") - 1).cast("long").alias("slot"))
