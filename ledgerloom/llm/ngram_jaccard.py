"""N-gram Jaccard self-join of documents by MinHash banding.

A document is its set of five-word shingles.  Texts with equal sets form a class and are looked at once.
Each class gets a MinHash signature; bands and rows are chosen so that a pair at the threshold shares a band
with the target recall.  Classes are shuffled on their band hashes; buckets with the same members are kept once.
Inside a bucket two members are candidates if their signatures (one byte of each minimum) agree as often as a
pair at the threshold does at least, within SIGMAS standard deviations; the bucket's candidates become the edges
of a spanning forest, never a list of pairs.  The connected groups of candidates are therefore near-copies and
not chains of chance collisions, however large the corpus is.  Each group's sets are brought together once
and all pairs in it are verified on the full sets.  Buckets and groups that are large (by members or by
shingles) are dealt over tasks by pairs of chunks, so no task holds more than two chunks, and links are counted
and spanned inside the task: with the classes' sizes every link is counted, between copies too, though
pairs are never written out.

Defined results: texts of one to four words have one shingle, all of their words; texts without words (null,
empty) link with nothing; a pair of exactly the threshold is linked.  A null doc_id is replaced by a hash of its
text as key (the output keeps null).  Repeated rows count as copies of each other.  A very long text is one set;
its words are hashed in pieces.  Sets are compared by 64-bit hashes of shingles.  Columns of docs besides id and text
are not read, so their names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, bitmap_of, doc_key, local_roots, removed, salted_join, slices, sorted_groups, tidy, written
from .components import connected_components
from .words import MIX, hashes_of, mixed, windows

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Members of a chunk of a group, and shingles that a chunk has on average at most (one text may have more).
CHUNK, CHUNK_SHINGLES = 128, 1 << 19
#: Members of a chunk of a bucket, of which only signatures are held.
BUCKET = 512
SIGMAS = 5.0


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective choice of at most `most` hashes that reaches the recall at the threshold."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return most, 1


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    words, ends = hashes_of(texts)
    return [np.unique(windows(w, tuple(range(min(n, len(w)))))) if len(w) else w for w in (words[a:b] for a, b in zip(ends, ends[1:]))]


def set_digest(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63


@cache
def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    a = mixed(np.arange(1, k + 1, dtype=np.uint64) * MIX)
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (mixed(a) >> np.uint64(32)).astype(np.uint32)


def minima(s: np.ndarray, k: int) -> np.ndarray:
    """The signature: for each of k hash functions its smallest value in the set."""
    a, b = _multipliers(k)
    low, short = np.full(k, np.iinfo(np.uint32).max, dtype=np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 512):
        np.minimum(low, (short[i : i + 512, None] * a + b).min(axis=0), out=low)
    return low


def band_hashes(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band, of the band's number and its minima."""
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = mixed(out * MIX + low[r::rows].astype(np.uint64))
    return out.view(np.int64)


def signature_bytes(low: np.ndarray) -> bytes:
    return (mixed(low.astype(np.uint64) * MIX) & np.uint64(255)).astype(np.uint8).tobytes()


def least_agreement(k: int, threshold: float) -> float:
    """How many of k signature bytes a pair at the threshold has in common, SIGMAS standard deviations below the mean."""
    p = threshold + (1 - threshold) / 256
    return k * p - SIGMAS * math.sqrt(k * p * (1 - p))


def _signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, n: int) -> DataFrame:
    schema = "id long, dk long, node long, mark long, th long, k long, bands array<long>, code binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "text")):
            out = []
            for s in shingle_sets(b.column("text").to_pylist(), n):
                low = minima(s, bands * rows) if len(s) else None
                out.append((*set_digest(s), len(s), band_hashes(low, bands, rows), signature_bytes(low)) if len(s) else (None, None, 0, None, None))
            x, y, k, h, c = map(list, zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("dk"), pa.array(x, pa.int64()), pa.array(y, pa.int64()), b.column("th"), pa.array(k, pa.int64()), pa.array(h, pa.list_(pa.int64())), pa.array(c, pa.binary())], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), doc_key(id_col, text_col).alias("dk"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(sign, schema)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; common elements by matrix products, rare ones by sorting."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float32)
    limit = max(4, n // 16)
    common = np.cumsum(times > limit) - 1
    heavy = times[index] > limit
    if heavy.any():
        cols, who = common[index[heavy]], owner[heavy]
        order = np.argsort(cols, kind="stable")
        cols, who = cols[order], who[order]
        for a in range(0, int(cols[-1]) + 1, 2048):
            lo, hi = np.searchsorted(cols, (a, a + 2048))
            m = np.zeros((n, 2048), dtype=np.float32)
            m[who[lo:hi], cols[lo:hi] - a] = 1
            out += m @ m.T
    light = (times[index] > 1) & ~heavy
    order = np.argsort(index[light], kind="stable")
    val, who = index[light][order], owner[light][order]
    for k in range(1, limit):
        same = np.flatnonzero(val[k:] == val[:-k])
        if not len(same):
            break
        pairs = np.bincount(who[same] * n + who[same + k], minlength=n * n).reshape(n, n)
        out += pairs + pairs.T
    return out


def _links(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = shared_counts(sets).astype(np.float64)
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu(both >= threshold * union - 1e-9, 1))
    return i, j


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["blob", "a", "b"]):
            node, at = np.unique(group["node"].to_numpy(), return_index=True)
            n, part = group["n"].to_numpy()[at], group["part"].to_numpy()[at]
            a, b = group["a"][0].as_py(), group["b"][0].as_py()
            column = group["words"].combine_chunks()
            sets = [np.frombuffer(column[int(k)].as_py(), dtype=np.uint64) for k in at]
            if len(sets) < 2:
                continue
            i, j = _links(sets, threshold)
            if a != b:  # pairs inside a chunk belong to another task
                cross = part[i] != part[j]
                i, j = i[cross], j[cross]
            links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
            some = links > 0
            root = node[local_roots(len(node), i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["node", "links", "root"])

    return run


def _dealt(rows: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """Each row in all pairs (a, b) of chunks that its own chunk `part` is in."""
    part = F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    out = rows.withColumn("part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    out = out.withColumn("a", F.least("part", "_other")).withColumn("b", F.greatest("part", "_other")).drop("_other", parts)
    return out.repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b")


def _agreeing(least: float):
    """Edges (node, root) that span the members of a bucket whose signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tidy(sorted_groups(batches, ["hash", "a", "b"])):
            node, at = np.unique(group["node"].to_numpy(), return_index=True)
            column = group["code"].combine_chunks()
            codes = np.frombuffer(b"".join(column[int(k)].as_py() for k in at), dtype=np.uint8).reshape(len(at), -1)
            root = np.arange(len(node))
            for x in range(0, len(node), 16):
                i, j = np.nonzero((codes[x : x + 16, None] == codes[None, x:]).sum(axis=2) >= least)
                root = local_roots(len(node), np.concatenate([np.arange(len(node)), x + i]), np.concatenate([root, x + j]))
            some = root != np.arange(len(node))
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["node", "root"])

    return run


def _blobs(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node, component) for every class that is a candidate of another: they share a bucket, and their signatures agree."""
    rows = classes.select("node", "code", F.explode("bands").alias("hash"))
    buckets = rows.groupBy("hash").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(buckets.groupBy("least", "most", "all", "size").agg(F.min("hash").alias("hash")).select("hash", "size", F.ceil(F.col("size") / BUCKET).cast("int").alias("parts")), "band-buckets")
    total = buckets.agg(F.sum("size")).first()[0] or 0
    members = salted_join(rows, buckets, ["hash"], "size", total, F.col("node"), "inner")
    edges = written(_dealt(members, ["hash"], "parts").mapInArrow(_agreeing(least_agreement(k, threshold)), "node long, root long"), "band-edges")
    out = connected_components(edges, "node", "root")
    removed(buckets, edges)
    return out


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """A row per document: id, key, class_id (smallest key with the same shingles), group_id (smallest key reached by
    links), n_links (other documents with a similarity of the threshold or more)."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(_signatures(docs, id_col, text_col, bands, rows, n), "signatures")
    classes = signed.where("node is not null").groupBy("node", "mark").agg(F.min(F.struct("dk", "th")).alias("r"), F.count(F.lit(1)).alias("n"), F.any_value("k").alias("k"), F.any_value("bands").alias("bands"), F.any_value("code").alias("code"))
    classes = written(classes.select("node", "mark", F.col("r.dk").alias("rep"), F.col("r.th").alias("th"), "n", "k", "bands", "code"), "classes")
    blobs = _blobs(classes, bands * rows, threshold).withColumnRenamed("component", "blob")
    blobs = written(blobs.join(classes.select("node", "rep", "th", "n", "k"), "node"), "blobs")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("k") / CHUNK_SHINGLES)).cast("int")
    sizes = written(blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("m"), parts.alias("parts")), "blob-sizes")
    members = written(salted_join(blobs, sizes, ["blob"], "m", blobs.count(), F.col("node"), "inner"), "blob-members")
    # the texts of members are sought in one more scan: a bitmap turns most others away before anything is shuffled
    named = F.xxhash64("rep", "th")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(members.select(named.alias("hash")), "hash"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows with equal id and text are copies: one of a task is enough
        for b in tidy(slices(batches, "text")):
            h = b.column("named").to_numpy()
            at = np.flatnonzero(among(wanted.value, h.view(np.uint64)))
            new = [i for i, x in zip(at.tolist(), h[at].tolist()) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(new, pa.int64()))
            sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("th"), pa.array(sets, pa.binary())], ["rep", "th", "words"])

    texts = docs.select(doc_key(id_col, text_col).alias("rep"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    loaded = texts.select("rep", "th", named.alias("named"), "text").mapInArrow(load, "rep long, th long, words binary").join(members, ["rep", "th"]).drop("rep", "th", "k")
    found = written(_dealt(loaded, ["blob"], "parts").mapInArrow(_verify(threshold), "node long, links long, root long"), "verified-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    nodes = classes.select("node", "mark", "rep", "n").join(links, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = written(nodes, "join-nodes")
    groups = written(nodes.groupBy("component").agg(F.min("rep").alias("group_id"), F.count(F.lit(1)).alias("k")), "join-groups")
    classed = written(salted_join(nodes, groups, ["component"], "k", nodes.count(), F.col("node"), "inner"), "join-classes")
    removed(classes, blobs, sizes, members, found, nodes, groups)
    out = salted_join(signed.select("id", "dk", "node", "mark"), classed.select("node", "mark", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "group_id"), ["node", "mark"], "n", classed.agg(F.sum("n")).first()[0] or 0, F.col("dk"), "left")
    out = out.select(F.col("id").alias(id_col), F.col("dk").alias("key"), F.coalesce("rep", "dk").alias("class_id"), F.coalesce("group_id", "dk").alias("group_id"), F.coalesce(F.col("links"), F.lit(0)).alias("n_links"))
    out.rests_on = (signed, classed)  # which a caller that has written the result may remove
    return out
