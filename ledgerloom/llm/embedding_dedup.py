"""Near-duplicate embeddings by product quantisation with an exact rerank.

Vectors of equal label and equal components form a class and are searched once.  A coarse k-means gives
inverted lists, about as many as the square root of the number of vectors; what a member differs from its list's centroid
is coded once by the nearest of 32 codewords in each of 8 subspaces, and the length of the coding error is kept
beside the code.  A query probes the lists whose centroids are nearest to it.  How many is measured when the index
is fitted: vectors of the sample get a partner at exactly the threshold in a random direction, the hardest
case, and so many lists are probed that PROBED of the partners lie in them.  A pair is found if either of its
vectors probes the other's list.  In a list the query reads each member's distance off its lookup tables
and drops members that cannot lie within the threshold even if the coding error helps (triangle
inequality, so this step loses nothing).  The rest are compared by exact cosine in double precision.
Every class is a query against all rows.  Lists and queries are cut into bounded blocks, links are counted
and spanned inside a block, and classes carry their sizes, so no pair is ever written out.

The index (centroids, codewords, number of probes) is fitted on a sample of about SAMPLE vectors, or 16 for each list where
that is more; all vectors are indexed.  Recall against brute force: MEASURED_RECALL.

Defined results: a vector whose label or embedding is null, that holds null or non-finite components or has
no length has no links and is its own component; vectors of different dimensions never link, and a very long one is
compared whole; repeated rows link with each other (cosine 1), and equal vectors of one label are one class; a cosine of
exactly the threshold links; labels of any type that has a text form are compared by it.  Components are computed in
double precision unless the table holds floats, which are widened.  A null vec_id keeps a null component and is
kept.  Other columns of the table, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import local_roots, removed, salted_join, slices, sorted_groups, tidy, written
from .components import connected_components

COSINE = 0.93
SAMPLE = 20_000
SUBSPACES, CODEWORDS = 8, 32
#: The share of partners at the threshold that lie in the probed lists, and how many vectors are asked for it.
PROBED, ASKED = 0.995, 4_000
MEMBERS, QUERIES = 1_024, 2_048
ROUNDS = 8


def _kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _units(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    """Coarse centroids, how many lists a query probes, and for each subspace the codewords of residuals."""

    dim: int
    centroids: np.ndarray
    probes: int
    edges: list[tuple[int, int]]
    words: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, cosine: float) -> Index:
        dim = sample.shape[1]
        centroids = _kmeans(sample, min(lists, len(sample)))
        own = ((centroids * centroids).sum(1) - 2 * sample @ centroids.T).argmin(1)
        residual = sample - centroids[own]
        cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        edges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        index = cls(dim, centroids, len(centroids), edges, [_kmeans(residual[:, a:b], min(CODEWORDS, len(residual))) for a, b in edges])
        rng = np.random.default_rng(11)
        x = sample[rng.permutation(len(sample))[:ASKED]]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-12)
        partner = cosine * x + np.sqrt(1 - cosine * cosine) * away
        far, goal = index._far(x), index._far(partner).argmin(1)
        rank = (far < far[np.arange(len(x)), goal][:, None]).sum(1)
        index.probes = int(np.quantile(rank, PROBED, method="higher")) + 1
        return index

    def _far(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The lists each vector probes, its own one first."""
        far = self._far(x)
        near = np.argpartition(far, self.probes - 1, axis=1)[:, : self.probes]
        return np.take_along_axis(near, np.take_along_axis(far, near, 1).argsort(1, kind="stable"), 1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = x - self.centroids[own]
        codes, miss = np.empty((len(x), len(self.edges)), dtype=np.uint8), np.zeros(len(x))
        for s, ((a, b), w) in enumerate(zip(self.edges, self.words)):
            codes[:, s] = ((w * w).sum(1) - 2 * r[:, a:b] @ w.T).argmin(1)
            miss += ((r[:, a:b] - w[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(miss)

    def distances(self, q: np.ndarray, codes: np.ndarray, own: int) -> np.ndarray:
        """Asymmetric distances of queries to coded members of a list, by table lookup."""
        r, out = q - self.centroids[own], np.zeros((len(q), len(codes)))
        for s, ((a, b), w) in enumerate(zip(self.edges, self.words)):
            part = r[:, a:b]
            out += ((part * part).sum(1)[:, None] + (w * w).sum(1) - 2 * part @ w.T)[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0))


def _search(shared, cosine: float):
    reach = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for group in tidy(sorted_groups(batches, ["label", "list", "mb", "qb"])):
            query = group["query"].to_numpy()
            q, m = np.flatnonzero(query), np.flatnonzero(~query)
            if not len(q) or not len(m):
                continue
            node, n, own = group["node"].to_numpy(), group["n"].to_numpy(), group["own"].to_numpy()
            x = _units(group["embedding"].combine_chunks(), index.dim)
            member = group.take(pa.array(m))
            codes = np.frombuffer(b"".join(member["codes"].to_pylist()), dtype=np.uint8).reshape(len(m), -1)
            near = index.distances(x[q], codes, group["list"][0].as_py()) <= reach + member["miss"].to_numpy() + 1e-9
            i, j = np.nonzero(near & (node[q][:, None] != node[m][None, :]))
            exact = np.concatenate([np.einsum("ij,ij->i", x[q[i[a : a + 65536]]], x[m[j[a : a + 65536]]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
            i, j = i[exact >= cosine], j[exact >= cosine]
            if not len(i):
                continue
            # whether the member, as a query, finds this query too; if not, the link is counted for both here
            probed = member["probes"].combine_chunks()
            wide = len(index.centroids)
            pairs = np.repeat(np.arange(len(m)), np.diff(probed.offsets.to_numpy())) * wide + probed.flatten().to_numpy()
            alone = ~np.isin(j * wide + own[q[i]], pairs)
            names, at = np.unique(np.concatenate([node[q], node[m]]), return_inverse=True)
            a, b = at[: len(q)][i], at[len(q) :][j]
            links = (np.bincount(a, n[m][j], len(names)) + np.bincount(b[alone], n[q][i[alone]], len(names))).astype(np.int64)
            root = names[local_roots(len(names), a, b)]
            some = (links > 0) | (root != names)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array(root[some])], ["node", "links", "root"])

    return run


def list_count(n: int) -> int:
    return max(1, round(n**0.5))


def _links(classes: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """(node, links, root) for the classes of one dimension."""
    wanted = max(SAMPLE, 16 * list_count(n))
    draw = F.pmod(F.col("node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / n)) + 1
    sample = classes.where(draw).select("embedding").toArrow()
    if not sample.num_rows:
        sample = classes.orderBy("node").select("embedding").limit(1).toArrow()
    index = Index.fit(_units(sample["embedding"].combine_chunks(), dim), list_count(n), cosine)
    shared = classes.sparkSession.sparkContext.broadcast(index)  # grows with the square root of n

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, index = _units(b.column("embedding"), dim), shared.value
            lists = index.lists(x).astype(np.int32)
            codes, miss = index.encode(x, lists[:, 0])
            probes = pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), lists.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists[:, 0]), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss)], [*b.schema.names, "own", "probes", "codes", "miss"])

    rows = classes.select("label", "node", "n", "embedding")
    schema = T.StructType([*rows.schema, T.StructField("own", T.IntegerType()), T.StructField("probes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("miss", T.DoubleType())])
    placed = written(rows.mapInArrow(assign, schema), "pq-lists")
    base = ("label", "node", "n", "embedding", "own")
    members = placed.select(*base, "probes", "codes", "miss", F.col("own").alias("list"), F.lit(False).alias("query"))
    nothing = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("probes", "codes", "miss")]
    queries = placed.select(*base, *nothing, F.explode("probes").alias("list"), F.lit(True).alias("query"))
    both = members.unionByName(queries)
    counts = both.groupBy("label", "list").agg(F.count_if(~F.col("query")).alias("m"), F.count_if("query").alias("q"), F.count(F.lit(1)).alias("all"))
    counts = written(counts.where("m > 0 and q > 0").select("label", "list", "all", F.ceil(F.col("m") / MEMBERS).cast("int").alias("ms"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qs")), "pq-counts")
    dealt = salted_join(both, counts, ["label", "list"], "all", counts.agg(F.sum("all")).first()[0] or 0, F.col("node"), "inner")
    h = F.xxhash64("node")
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    one = lambda k: F.array(F.pmod(h, F.col(k)).cast("int"))
    dealt = dealt.withColumn("mb", F.explode(F.when(F.col("query"), every("ms")).otherwise(one("ms")))).withColumn("qb", F.explode(F.when(F.col("query"), one("qs")).otherwise(every("qs"))))
    keys = ["label", "list", "mb", "qb"]
    return dealt.drop("ms", "qs").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(shared, cosine), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """A row per vector: id, n_links, component_id (smallest id reached), kept."""
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), T.FloatType)
    v = F.col(vector_col).cast(f"array<{'float' if single else 'double'}>")
    usable = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))
    good = rows.where("usable").withColumn("node", F.xxhash64("label", "embedding"))
    classes = written(good.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")), "vector-classes")
    dims = classes.groupBy(F.size("embedding").alias("d")).count().collect()
    none = classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).limit(0)
    found = written(reduce(DataFrame.unionByName, (_links(classes.where(F.size("embedding") == r.d), r.d, r["count"], cosine) for r in dims), none), "vector-links")
    reached = connected_components(found.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("node", "rep", "n").join(links, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = written(nodes, "vector-nodes")
    groups = written(joined.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("k")), "vector-groups")
    nodes = salted_join(joined, groups, ["component"], "k", joined.count(), F.col("node"), "inner")
    results = written(nodes.select("node", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "vector-results")
    removed(classes, found, joined, groups)
    keyed = rows.select("id", F.when(F.col("usable"), F.xxhash64("label", "embedding")).alias("node"))
    out = salted_join(keyed, results, ["node"], "n", results.agg(F.sum("n")).first()[0] or 0, F.col("id"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").eqNullSafe(component) | F.col("id").isNull()).alias("kept"))
