"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree (order up to 3) holds how often each byte followed
each context.  A byte's probability is its share in the longest known context; an unseen byte costs that
context's escape probability (method C: kinds of bytes seen / (visits + kinds)) and is looked up one order
lower, without the bytes that the longer context has, down to a uniform share.  Statistics are frozen after
fitting, so a byte's exact code length depends on the three bytes before it alone, and a text's code length is a sum
over its four-byte grams: the tree keeps, for each order, the grams that were seen and the cost of leaving a
seen context.  Texts are compared in lower case as UTF-8.  Prediction: the shortest code.

Fitting uses a bounded sample of labelled rows: about ROWS_PER_LANG rows of each language, chosen by a
hash of their id and length.  The model, which is broadcast, holds the grams of that sample and nothing else.
Scoring covers every whole text.

Defined results: null text, or a text without any letter (so an empty one too): `und`, score 0.  No labelled
row at all: every row is `und`.  Ties go to the language that sorts first.  Repeated rows get equal
predictions.  A very long text is scored as a whole, in the memory of its bytes.  A column of docs that is
named like a result is replaced by it; other names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, slices, tidy

ROWS_PER_LANG = 600
ORDER = 3
UNKNOWN = "und"
#: A draw is one of so many numbers.
DRAWS = 1_000_000


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte grams of texts in lower case, each of which starts with three line breaks as context, and their text's number."""
    parts = [b"\n\n\n" + t.lower().encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    if len(flat) < 4:
        return flat[:0], np.zeros(0, dtype=np.int64)
    gram = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    inside = owner[:-3] == owner[3:]
    return gram[inside], owner[:-3][inside]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four-byte grams for each language, of whole texts."""
    for b in tidy(slices(batches, "text")):
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            keys, n = np.unique(_grams([t for t, x in zip(texts, langs) if x == lang])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted number its place in the sorted keys (at least one), and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ContextTree:
    """One language's frozen code lengths: for each order the grams that were seen, and what leaving a seen context costs."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = np.zeros(0)
        for order in range(ORDER + 1):
            g, at = np.unique(gram.astype(np.uint32) & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n)
            context, own = np.unique(g >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(own, count), np.bincount(own)
            below = np.full(len(g), 1 / 256) if not order else lower[_find(self.grams[-1], g & np.uint32((1 << 8 * order) - 1))[0]]
            rest = 1 - np.bincount(own, below)  # what the bytes that this context never had hold one order lower
            some = rest > 1e-9
            p = count / np.where(some, total + kinds, total)[own]
            self.grams.append(g)
            self.bits.append(-np.log2(p).astype(np.float32))
            self.contexts.append(context)
            self.escapes.append(-np.log2(np.where(some, kinds / (total + kinds), 1) / np.where(some, rest, 1)).astype(np.float32))
            lower = p

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte gram."""
        out, todo = np.zeros(len(gram)), np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            g = gram[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, seen = _find(self.grams[order], g)
            out[todo[seen]] += self.bits[order][at[seen]]
            todo, g = todo[~seen], g[~seen]
            at, known = _find(self.contexts[order], g >> np.uint32(8))
            out[todo[known]] += self.escapes[order][at[known]]
        out[todo] += 8
        return out


class ContextTrees:
    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.trees = langs, [ContextTree(*grams[x]) for x in langs]

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text for each language, and its bytes."""
        gram, owner = _grams(texts)
        each, at = np.unique(gram, return_inverse=True)
        out = np.zeros((len(texts), len(self.langs)))
        for i, tree in enumerate(self.trees):
            out[:, i] = np.bincount(owner, tree.lengths(each)[at], minlength=len(texts))
        return out, np.bincount(owner, minlength=len(texts))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> ContextTrees | None:
    """Learn from the rows of docs that have a text and a language."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.length("text")), F.lit(DRAWS))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return None
    share = F.lit(0)  # at least the smallest draw of each language is taken
    for r in counts:
        share = F.when(F.col("lang") == r.lang, int(max(r.least + 1, DRAWS * min(1.0, rows_per_lang / r.n)))).otherwise(share)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    grams = rows.where(draw < share).select("text", "lang").mapInArrow(_gram_counts, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(grams["lang"].unique())
    if not langs:  # only empty texts
        return None
    return ContextTrees(langs, {x: (g["gram"].to_numpy(), g["n"].to_numpy()) for x, g in grams.groupby("lang")})


RESULTS = ("lang_pred", "score", "bits_per_byte")


def predict(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text", passed: list[str] | None = None) -> DataFrame:
    """docs' columns `passed` (by default all but those named like results) with lang_pred, score and bits_per_byte."""
    passed = others(docs, *RESULTS) if passed is None else passed
    own = free_name(docs, "_text")
    base = docs.select(*passed, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias(own))
    if trees is None:
        return base.select(*passed, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    model = docs.sparkSession.sparkContext.broadcast(trees)  # holds the grams of the bounded sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in tidy(slices(batches, own)):
            texts = b.column(b.num_columns - 1).to_pylist()
            has = np.array([t is not None for t in texts], dtype=bool)
            lang, sure, per = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if has.any():
                bits, size = m.lengths([t for t in texts if t is not None])
                shortest = bits.min(1)
                lang[has], per[has] = np.array(m.langs, dtype=object)[bits.argmin(1)], shortest / size
                sure[has] = 1 / np.exp2(np.maximum(shortest[:, None] - bits, -1000)).sum(1)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(sure), pa.array(per, from_pandas=True)], [*b.schema.names[:-1], *RESULTS])

    schema = T.StructType([*(docs.schema[c] for c in passed), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return base.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for a fifth of the ids: those never learned from.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", passed: list[str] | None = None) -> DataFrame:
    """Fit on the documents that are not held out, predict for all of them."""
    return predict(docs, fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col), text_col, passed)
