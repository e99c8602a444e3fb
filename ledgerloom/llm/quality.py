"""Quality classification by hierarchical empirical Bayes.

A logistic classifier on features of the whole text gives a document's own evidence: shares of byte classes,
measures of words and lines, and the shares of hashed words and hashed byte trigrams.  Sites are a host and a
path below it; their labelled documents are counted by grouped aggregation, and each level's rate is a
beta-binomial posterior shrunk towards the level above (path towards host, host towards the global rate).
How strongly is estimated from all sites at once by the method of moments, from sums that Spark aggregates.
A document whose own label was counted is left out of its path's and host's counts.
The final log odds add the document's evidence and what its path's posterior says beyond the global rate.

The classifier is fitted on a bounded sample of at most about SAMPLE_ROWS labelled documents; site counts use
every labelled row that is not held out.

Defined results: a null or empty text has zero features, a very long one is measured whole; a null host or path is a site
of its own; labels that are null or not 0/1 are ignored, repeated labels of a document are averaged; rows that share an id
share its label, and one of them enters the sample; without any usable label every score is 0.5.  Repeated rows get equal
scores.  A quality of exactly 0.5 is kept.  Other columns of the tables, whatever their names, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import salted_join, slices, tidy, written
from .words import hashes_of

SAMPLE_ROWS = 8_000
RIDGE = 20.0
CLASSES = np.full(256, 6)  # of bytes: other symbols
CLASSES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
CLASSES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
CLASSES[[ord(c) for c in "0123456789"]] = 2
CLASSES[[9, 10, 13, 32]] = 3
CLASSES[[ord(c) for c in ".,;:!?'\"-()"]] = 4
CLASSES[128:] = 5
SURFACE, HASHED = 14, 256
FEATURES = SURFACE + 2 * HASHED


def features_of(texts: list[str | None]) -> np.ndarray:
    words, ends = hashes_of(texts)
    bucket = (words >> np.uint64(56)).astype(np.int64)
    return np.array([_features(t, bucket[a:b]) for t, a, b in zip(texts, ends, ends[1:])]).reshape(-1, FEATURES)


def _features(text: str | None, buckets: np.ndarray) -> np.ndarray:
    """Shares of byte classes, measures of words, repeats and lines, and roots of the shares of hashed words and byte trigrams."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    out[SURFACE : SURFACE + HASHED] = np.sqrt(np.bincount(buckets, minlength=HASHED) / max(len(buckets), 1))
    grams = (raw[:-2].astype(np.uint32) * np.uint32(961) + raw[1:-1].astype(np.uint32) * np.uint32(31) + raw[2:]) * np.uint32(2654435761) >> np.uint32(24)
    out[SURFACE + HASHED :] = np.sqrt(np.bincount(grams, minlength=HASHED) / max(len(grams), 1))
    counts = np.bincount(CLASSES[raw], minlength=7)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    out[:7] = counts / len(raw)
    out[7] = len(set(words)) / n
    out[8] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[9] = min(np.log1p(len(raw)) / 10, 2.0)
    out[10] = min(len(raw) / n / 10, 3.0)
    out[11] = len(set(lines)) / len(lines)
    out[12] = min(n / len(lines) / 50, 3.0)
    out[13] = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,") / n
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last is the intercept), by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, rate: Column, k: str = "k", n: str = "n") -> float:
    """Pseudo-count of a level's prior, by moments: large when groups differ no more than chance makes them."""
    used = groups.where(F.col(n) > 0).withColumn("_m", rate)
    r = used.agg(
        F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - F.col("_m"), 2) / F.greatest(F.col("_m") * (1 - F.col("_m")), F.lit(1e-9))).alias("s"),
        F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"),
    ).first()
    if not r.n or r.g < 2:
        return 1e4
    free = r.n - r.nn / r.n - (r.g - 1)
    rho = (r.s - (r.g - 1)) / free if free > 0 else 0.0
    rho = min(max(rho, 1e-4), 0.99)
    return (1 - rho) / rho


def document_evidence(docs: DataFrame, labels: DataFrame, text_col: str, passed: list[str]) -> DataFrame:
    """docs' columns `passed` with p_document; labels: (_id, _y).  The sample is drawn from the labels and is small
    enough by SAMPLE_ROWS to be broadcast, so texts are never shuffled."""
    n = labels.count()
    kind = "_id string, f array<float>, y double"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "t")):
            x = features_of(b.column("t").to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(list(x), pa.list_(pa.float32())), b.column("_y")], ["_id", "f", "y"])

    draw = F.pmod(F.xxhash64("_id", "_y"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_ROWS / max(n, 1)))
    drawn = docs.join(F.broadcast(labels.where(draw)), "_id").select(F.col("_id").cast("string"), F.col(text_col).alias("t"), F.col("_y").cast("double"))
    sample = drawn.mapInArrow(measure, kind).groupBy("_id").agg(F.min(F.struct("f", "y")).alias("s")).select("s.f", "s.y").toArrow()
    y = sample["y"].to_numpy()
    if not len(y):
        return docs.select(*passed, F.lit(0.5).alias("p_document"))
    mean, scale, w = logistic(np.concatenate(sample["f"].to_numpy()).reshape(-1, FEATURES).astype(np.float64), y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "_text")):
            last = b.num_columns - 1
            x = features_of(b.column(last).to_pylist())
            z = np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(last)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*b.schema.names[:-1], "p_document"])

    schema = T.StructType([*(docs.schema[c] for c in passed), T.StructField("p_document", T.DoubleType())])
    return docs.select(*passed, F.col(text_col).alias("_text")).mapInArrow(score, schema)


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """rows (_host, _path, _y or null) -> one row per path (_host, _path, host_posterior, path_posterior, _rows, and what they
    come from: k of n labels of the path, hk of hn of the host, the priors' weights), and the global rate."""
    counts = rows.groupBy("_host", "_path").agg(F.count("_y").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("k"), F.count(F.lit(1)).alias("_rows"))
    paths = written(counts, "quality-paths")
    whole = paths.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    rate = (whole.k + 0.5) / (whole.n + 1) if whole.n else 0.5
    hosts = written(paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"), F.count(F.lit(1)).alias("_paths")), "quality-hosts")
    strong = _strength(hosts, F.lit(rate), "hk", "hn")
    hosts = hosts.select("_host", "_paths", "hk", "hn", ((F.col("hk") + strong * rate) / (F.col("hn") + strong)).alias("host_posterior"))
    n_paths = hosts.agg(F.sum("_paths")).first()[0] or 0
    joined = salted_join(paths, hosts, ["_host"], "_paths", n_paths, F.col("_path"), "inner")
    joined = written(joined, "quality-sites")
    weak = _strength(joined, F.col("host_posterior"))
    path = (F.col("k") + weak * F.col("host_posterior")) / (F.col("n") + weak)
    return joined.select("_host", "_path", "host_posterior", path.alias("path_posterior"), "_rows", "k", "n", "hk", "hn", F.lit(strong).alias("strong"), F.lit(weak).alias("weak")), rate


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", learn: Column | None = None) -> DataFrame:
    """(id, p_document, host_posterior, path_posterior, quality, keep); learn: which ids' labels may be used."""
    clean = labels.where(F.col(label).isin(0, 1)).where(F.lit(True) if learn is None else learn).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label).alias("_y"))
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"), F.col(text_col).alias("_doc"))
    scored = document_evidence(base, clean, "_doc", ["_id", "_host", "_path"])
    sites, rate = site_posteriors(base.select("_id", "_host", "_path").join(clean, "_id", "left"))
    sites = written(sites, "quality-posteriors")
    total = sites.agg(F.sum("_rows")).first()[0] or 0
    joined = salted_join(scored.join(clean, "_id", "left"), sites.drop("host_posterior", "path_posterior"), ["_host", "_path"], "_rows", total, F.col("_id"), "inner")
    own, y = F.col("_y").isNotNull().cast("int"), F.coalesce("_y", F.lit(0.0))
    of_host = (F.col("hk") - y + F.col("strong") * rate) / (F.col("hn") - own + F.col("strong"))
    of_path = (F.col("k") - y + F.col("weak") * of_host) / (F.col("n") - own + F.col("weak"))
    odds = _logit(F.col("p_document")) + _logit(of_path) - _logit(F.lit(rate))
    quality = 1 / (1 + F.exp(-odds))
    return joined.select(F.col("_id").alias(id_col), "p_document", of_host.alias("host_posterior"), of_path.alias("path_posterior"), quality.alias("quality"), (quality >= 0.5).alias("keep"))
