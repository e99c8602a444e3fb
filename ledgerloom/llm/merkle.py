"""A Merkle manifest of a table of documents: leaves, nodes linked to their parents, and proofs climbed by a recursive query.

Each row is a leaf: the digest of its fields.  The leaves of a language, by id, make a tree of runs of FANOUT nodes; the
trees' roots, by language, make one more.  Levels are built from below, each from the written one before it, and stored
as node rows: id, parent, place in the parent's run, and the digests of the run below it.  A recursive query then takes
every leaf up: each step appends a row with the siblings that it meets and folds the leaf's digest into its run's.

Scale: a row's place among all rows comes from ranges of (language, id), their sums and places within them, so no
language meets in one task.  A node above more than BLOCK leaves is stored once for each BLOCK of them, and the
climb joins by node and block, so at most BLOCK leaves meet one row, at the root too.  Node ids are numbers: a tree's
node has its first leaf's place and its level, a node above the trees its place and TOP plus its level.

Defined results: null fields are hashed as `-`; null languages are a tree, the first one; null ids come first in it;
empty texts are texts of no bytes, texts of any length are hashed whole; rows with equal language and id are in the
order of their leaves, and rows equal in all fields stand side by side with leaves and proofs of their own; a single row
is its own root with the proof of no siblings; an empty table gives no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, written

FANOUT, BITS = 8, 3
#: Leaves that share one copy of a node.
BLOCK = 4096
#: Levels from here on are above the trees.
TOP = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """A field as it is hashed: `-` for null, else its UTF-8 bytes' count, a colon and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_of(**changed: Column) -> Column:
    """The digest of a row; `changed` replaces fields."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def tampered() -> Column:
    """Which rows the query tampers with: those whose id, in decimal, has a CRC-32 that 3 divides."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


@dataclass
class Manifest:
    """leaves: place, doc_id, lang, leaf, folded, node, slot; nodes: id, block, parent, slot, children, subroot; root: hex, or None."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    rests_on: list[DataFrame]


def _placed(rows: DataFrame) -> DataFrame:
    """rows (lang, doc_id, leaf, folded, copies) with place, and its tree's first place, size and rank among the trees."""
    order = ["lang", "doc_id", "leaf"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    ranged = written(ranged, "leaves")
    # a row for each range: what stands before it
    parts = ranged.groupBy("part").agg(F.sum("copies").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("copies").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("inside", before).drop("seq")
    shares = numbered.groupBy("part", "lang").agg(F.min("inside").alias("inside"), F.sum("copies").alias("n"))
    shares = written(shares.join(F.broadcast(parts), "part").withColumn("at", F.col("base") + F.col("inside")).drop("inside"), "shares")
    trees = shares.groupBy("lang").agg(F.min("at").alias("first"), F.min_by("part", "at").alias("part"), F.sum("n").alias("size"))
    begun = trees.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begun = begun.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ranks"))
    trees = trees.join(F.broadcast(begun), "part").withColumn("rank", F.col("ranks") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1)
    trees = trees.select(F.col("lang").alias("tree_lang"), "first", "size", "rank")
    # by range and language, so that a language's rows stay in their ranges
    own = shares.join(trees, F.col("lang").eqNullSafe(F.col("tree_lang"))).select(F.col("part").alias("own_part"), "base", "tree_lang", "first", "size", "rank")
    placed = numbered.join(own, (F.col("part") == F.col("own_part")) & F.col("lang").eqNullSafe(F.col("tree_lang")))
    placed = placed.withColumn("place", F.explode(F.sequence(F.col("base") + F.col("inside"), F.col("base") + F.col("inside") + F.col("copies") - 1)))
    out = written(placed.select("place", "doc_id", "lang", "leaf", F.unhex("leaf").alias("digest"), F.unhex("folded").alias("folded"), "first", "size", "rank"), "placed")
    removed(ranged, shares)
    return out


def _levels(level: DataFrame) -> list[DataFrame]:
    """All levels of the trees over `level` (tree, size, at, low, high, digest: size nodes at places 0.. of a tree), the lowest first.

    Each level is a written table with the id, run and `alone`: whether the tree ends there."""
    out, height = [], 0
    while True:
        width = FANOUT**height
        left = F.floor((F.col("size") + (width - 1)) / width)
        out.append(level.withColumn("alone", left <= 1).withColumn("height", F.lit(height)))
        rising = out[-1].where(~F.col("alone"))
        if not rising.take(1):
            return out
        run = F.shiftright("at", BITS)
        children = F.sort_array(F.collect_list(F.struct("at", "digest", "low", "high")))
        up = rising.groupBy("tree", "size", run.alias("run")).agg(children.alias("c"))
        below = F.array_join(F.transform("c", lambda c: _hex(c["digest"])), "")
        up = up.select("tree", "size", F.col("run").alias("at"), F.array_min("c.low").alias("low"), F.array_max("c.high").alias("high"), F.unhex(F.sha2(below, 256)).alias("digest"), F.unhex(below).alias("children"))
        level = written(up, "level")
        height += 1


def _parent(height: Column, alone: Column, at: Column, first: Column, rank: Column, trees: int) -> tuple[Column, Column]:
    """The id of the node above one in a tree, and the place in its run."""
    above = first + F.shiftleft(F.shiftright(at, BITS), BITS) * F.pow(F.lit(FANOUT), height).cast("long")
    to_top = F.shiftright(rank, BITS) * 64 + (TOP + 1) if trees > 1 else F.lit(None).cast("long")
    return F.when(alone, to_top).otherwise(above * 64 + height + 1), F.when(alone, rank % FANOUT).otherwise(at % FANOUT).cast("int")


def manifest(docs: DataFrame, altered: Column | None = None, **changed: Column) -> Manifest:
    """Leaves and nodes of docs.  Where `altered` holds, the leaf to be folded is that of the row with the `changed` fields."""
    leaf = leaf_of()
    folded = leaf if altered is None else F.when(altered, leaf_of(**changed)).otherwise(leaf)
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), folded.alias("folded")).groupBy("lang", "doc_id", "leaf").agg(F.min("folded").alias("folded"), F.count(F.lit(1)).alias("copies"))
    placed = _placed(rows)
    bottom = placed.select(F.col("first").alias("tree"), "size", (F.col("place") - F.col("first")).alias("at"), F.col("place").alias("low"), F.col("place").alias("high"), "digest")
    levels = _levels(bottom)
    ranks = placed.where("place = first").select(F.col("first").alias("tree"), "rank")  # one row a tree
    ends = reduce(DataFrame.unionByName, [x.where("alone").select("tree", "digest", "low", "high") for x in levels])
    ends = written(ends.join(ranks, "tree"), "subroots")
    trees = ends.count()
    above = _levels(ends.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.col("rank").alias("at"), "low", "high", "digest"))
    root = above[-1].select(_hex("digest")).first() if trees else None
    nodes = []
    for x in levels[1:]:
        parent, slot = _parent(F.col("height"), F.col("alone"), F.col("at"), F.col("tree"), F.col("rank"), trees)
        x = x.where("alone").join(ranks, "tree").unionByName(x.where("not alone").withColumn("rank", F.lit(None).cast("long")))
        nodes.append(x.select((F.col("low") * 64 + F.col("height")).alias("id"), parent.alias("parent"), slot.alias("slot"), "children", F.when(F.col("alone"), F.col("digest")).alias("subroot"), "low", "high"))
    for x in above[1:]:
        parent = F.when(~F.col("alone"), F.shiftright("at", BITS) * 64 + (TOP + 1) + F.col("height"))
        nodes.append(x.select((F.col("at") * 64 + TOP + F.col("height")).alias("id"), parent.alias("parent"), (F.col("at") % FANOUT).cast("int").alias("slot"), "children", F.lit(None).cast("binary").alias("subroot"), "low", "high"))
    leaves = placed.withColumn("alone", F.col("size") == 1)
    parent, slot = _parent(F.lit(0), F.col("alone"), F.col("place") - F.col("first"), F.col("first"), F.col("rank"), trees)
    leaves = leaves.select("place", "doc_id", "lang", "leaf", "folded", parent.alias("node"), slot.alias("slot"), F.when(F.col("alone"), F.col("digest")).alias("subroot"))
    if not nodes:  # a single row, or none
        nodes = [leaves.where("false").select(F.col("node").alias("id"), F.col("node").alias("parent"), "slot", F.col("folded").alias("children"), "subroot", F.col("place").alias("low"), F.col("place").alias("high"))]
    blocks = F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))
    stored = written(reduce(DataFrame.unionByName, nodes).withColumn("block", F.explode(blocks)).drop("low", "high"), "nodes")
    removed(*levels[1:], *above[1:], ends)
    return Manifest(leaves, stored, root[0] if root else None, [placed, stored])


CLIMB = """
WITH RECURSIVE climb(place, step, node, slot, folded, siblings, subroot) AS (
  SELECT place, 0, node, slot, folded, CAST(NULL AS BINARY), subroot FROM {leaves}
  UNION ALL
  SELECT c.place, c.step + 1, n.parent, n.slot,
    unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.slot), c.folded, substring(n.children, 32 * c.slot + 33)))), 256)),
    concat(substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33)), n.subroot
  FROM climb c JOIN {nodes} n ON n.id = c.node AND n.block = c.place DIV {block}
)
SELECT place, step, node, folded, siblings, subroot FROM climb
"""


def climb(m: Manifest, of_proof: Callable[[Column], Column] = lambda proof: proof) -> DataFrame:
    """place, proof (hex of all siblings, level by level), subroot (hex) and folded_root (hex): a row for each leaf.

    A proof has some 450 bytes a level; where a digest of it is enough, `of_proof` makes that before anything is written.
    Spark stops a recursive query at a number of rows that its session sets; the climb has as many rows as leaves and levels."""
    spark = m.leaves.sparkSession
    limit = spark.conf.get(RECURSION_ROWS)
    spark.conf.set(RECURSION_ROWS, "-1")
    try:
        steps = spark.sql(CLIMB, leaves=m.leaves.select("place", "node", "slot", "folded", "subroot"), nodes=m.nodes, block=BLOCK)
        met = F.sort_array(F.collect_list(F.when(F.col("siblings").isNotNull(), F.struct("step", "siblings"))))
        proof = F.array_join(F.transform(met, lambda x: _hex(x["siblings"])), "")
        ended = steps.groupBy("place").agg(of_proof(proof).alias("proof"), _hex(F.max("subroot")).alias("subroot"), _hex(F.max(F.when(F.col("node").isNull(), F.col("folded")))).alias("folded_root"))
        return written(ended, "proofs")
    finally:
        spark.conf.set(RECURSION_ROWS, limit)


def verified(m: Manifest, of_proof: Callable[[Column], Column] = lambda proof: proof) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof, folded_root, verified: a row for each leaf."""
    root = F.lit(m.root).cast("string")
    found = m.leaves.select("place", "doc_id", "lang", "leaf").join(climb(m, of_proof), "place")
    return found.select("doc_id", "lang", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The query's digests: all rows, of which the tampered ones have the letters A-Z of their text lower-cased."""
    m = manifest(docs, tampered(), text=F.translate("text", UPPER, LOWER))
    out = verified(m, lambda proof: F.sha2(proof, 256))
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")
