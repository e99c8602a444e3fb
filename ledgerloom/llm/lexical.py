"""Ranked lexical search by hashed max-sketches: upper bounds for all documents, exact scores where a bound reaches the threshold.

The index knows no queries.  A document's impact of a term grows with the term's occurrences, so the document's sketch folds
occurrences: each term is hashed to a coordinate in each of ROWS rows, and a coordinate holds the most occurrences of any
term there (255: that or more, which counts as the largest impact that there is).  A row has at least ROOM coordinates
for each different term of its document, so sketches of short and long documents are equally sharp.  Beside the sketches
stand the document frequencies of all terms and the totals.

A search looks a block of queries up in every sketch: the least of a term's coordinates bounds its occurrences, so its weight
times that impact bounds its share, and the sum bounds the score.  First the PROBES documents of the highest bounds of each query are
scored exactly; the last of the best k is the threshold.  Then every document whose bound reaches the threshold is scored exactly, and
the best k are the result.  Bounds and scores are whole numbers, so nothing is lost to rounding.

Scale: queries go in blocks of about BLOCK_TERMS terms, which is what the tasks are sent; sketches are scanned where they lie.  Of equal texts only
the k of the smallest ids can be among the best, so of a group of copies no more than k rows a query are kept, before any shuffle, and its
text is scored once.  Texts are found through a bitmap of fixed size and only texts to be scored are shuffled.

Defined results: a null text, or one without terms, is no document of the corpus; queries without terms, or with none that the
corpus has, give no rows; rows of queries with equal ids are one query with the terms of all; equal scores are ranked by id, null
ids last; rows equal in id and text are documents of their own, each with a rank; texts of any length are taken whole; empty tables give no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, removed, slices, tidy, with_flag, written

ROWS, ROOM, PROBES = 2, 4, 32
#: Query terms in a block, sketch cells of a block looked up at a time, and terms counted before they are given out.
BLOCK_TERMS, CELLS, COUNTED = 1 << 18, 1 << 21, 1 << 18
#: Fixed values of the score: what impacts are multiplied by, and the document length's weight in hundredths.
SCALE, PER_TF, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90
MANY = 255
#: Bytes of terms: ASCII letters and digits, in lower case, and all bytes of other characters; the rest separates.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8.  Runs of the bytes above are runs of the characters that they encode."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def coordinates(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def _at(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where terms stand in each row of a sketch with 2 ** bits coordinates a row."""
    return [((hashes >> np.uint64(row * 32)) & np.uint64((1 << bits) - 1)).astype(np.int64) + (row << bits) for row in range(ROWS)]


def sketch(counts: Counter) -> bytes:
    bits = max(3, (ROOM * len(counts) - 1).bit_length())
    out = np.zeros(ROWS << bits, dtype=np.uint8)
    times = np.minimum(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), MANY).astype(np.uint8)
    for at in _at(coordinates([*counts]), bits):
        np.maximum.at(out, at, times)
    return out.tobytes()


def impact(tf, m):
    return SCALE * tf // (PER_TF * tf + PER_LENGTH * m)


def _text_keys(text_col: str) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(F.col(text_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2")]


@dataclass
class Index:
    """sketches: doc_id, h1, h2 (naming the text), n, sketch; frequencies: term, df; documents and terms: the totals."""

    sketches: DataFrame
    frequencies: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_keys(text_col), F.col(text_col).alias("text")).where("text is not null")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "text")):
            held, sizes, folded = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                if counts := Counter(terms(text)):
                    held.append(i)
                    sizes.append(counts.total())
                    folded.append(sketch(counts))
            if held:
                b = b.take(pa.array(held))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(folded, pa.binary())], ["doc_id", "h1", "h2", "n", "sketch"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given():
            return pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.int64())], ["term", "n"])

        for b in tidy(slices(batches, "text")):
            for text in b.column(0).to_pylist():
                held.update(set(terms(text)))
                if len(held) > COUNTED:
                    yield given()
                    held.clear()
        yield given()

    path = new_path(spark, "sketches")  # mostly zeros, so the codec matters
    own.mapInArrow(fold, "doc_id long, h1 long, h2 long, n long, sketch binary").write.option("compression", "zstd").parquet(path)
    sketches = spark.read.schema("doc_id long, h1 long, h2 long, n long, sketch binary").parquet(path)
    sketches.written_to = path
    frequencies = written(own.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    totals = sketches.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(sketches, frequencies, totals.documents, totals.terms)


@dataclass
class Block:
    """A block of queries as arrays: different terms with their hashes and weights, and each item's terms by number, item after item."""

    items: list
    words: list[bytes]
    weights: np.ndarray
    hashes: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    documents: int
    all_terms: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * self.documents) // self.all_terms

    def bounds(self, sketches: list[bytes], n: np.ndarray) -> np.ndarray:
        """documents x items, for sketches of one size."""
        cells = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
        bits = (cells.shape[1] // ROWS).bit_length() - 1
        tf = reduce(np.minimum, (cells[:, at] for at in _at(self.hashes, bits)))
        table = impact(np.arange(MANY + 1, dtype=np.int64)[None, :], self.lengths(n)[:, None])
        table[:, MANY] = SCALE // PER_TF
        shares = np.take_along_axis(table, tf.astype(np.int64), axis=1) * self.weights
        return np.add.reduceat(shares[:, self.flat], self.starts, axis=1)

    def score(self, counts: Counter, item: int, m: int) -> int:
        end = self.starts[item + 1] if item + 1 < len(self.starts) else len(self.flat)
        return sum(int(self.weights[u]) * impact(tf, m) for u in self.flat[self.starts[item] : end].tolist() if (tf := counts.get(self.words[u])))


def _asked(queries: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """item, term, w: the different terms of each item that weigh anything."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [(i, t) for i, text in enumerate(b.column(1).to_pylist()) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([t for _, t in rows], pa.binary())], ["item", "term"])

    item = queries.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    found = item.mapInArrow(split, f"item {item.schema['item'].dataType.simpleString()}, term binary").distinct()
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return found.join(index.frequencies, "term").select("item", "term", weight.alias("w")).where("w > 0")


def _blocks(asked: DataFrame, index: Index) -> Iterator[Block]:
    total = asked.count()
    many = -(-total // BLOCK_TERMS)
    for k in range(many):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(many)) == k).collect()  # about BLOCK_TERMS
        by: dict = {}
        for r in rows:
            by.setdefault(r.item, []).append((bytes(r.term), r.w))
        if not by:
            continue
        weights = {t: w for found in by.values() for t, w in found}
        number = {t: u for u, t in enumerate(weights)}
        sizes = [len(v) for v in by.values()]
        yield Block([*by], [*weights], np.array([*weights.values()], dtype=np.int64), coordinates([*weights]), np.array([number[t] for v in by.values() for t, _ in v]), np.cumsum([0, *sizes[:-1]]), index.documents, index.terms)


FOUND = "item int, doc_id long, h1 long, h2 long, bound long"
#: Stands for a null id, which comes after all others.
LAST = np.iinfo(np.int64).max


def _highest_of(parts: list[tuple]) -> tuple:
    """The PROBES highest bounds of each item, of rows (item, id, h1, h2, bound) as columns; in the order of items and bounds."""
    item, doc, _, _, bound = columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((doc, -bound, item))
    sorted_item = item[order]
    order = order[np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item, "left") < PROBES]
    return tuple(c[order] for c in columns)


def _looked_up(index: Index, block: Block, least: np.ndarray | None = None, last: np.ndarray | None = None) -> DataFrame:
    """Documents with their bounds: of each item each task's PROBES highest or, with thresholds (score and id), all that reach them."""
    many = len(block.items)

    def bounded(b: pa.RecordBatch) -> Iterator[tuple]:
        doc = b.column(0).fill_null(LAST).to_numpy()
        h1, h2, n, held = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist()
        sizes = np.array([len(x) for x in held])
        step = max(1, CELLS // len(block.flat))
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            for part in (of[a : a + step] for a in range(0, len(of), step)):
                yield doc[part], h1[part], h2[part], block.bounds([held[i] for i in part], n[part])

    def given(item, doc, h1, h2, bound) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=doc == LAST), pa.array(h1), pa.array(h2), pa.array(bound)], ["item", "doc_id", "h1", "h2", "bound"])

    def rows(doc, h1, h2, bound, hit) -> tuple:
        row, item = np.nonzero(hit)
        return item, doc[row], h1[row], h2[row], bound[row, item]

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, floor = [], np.ones(many, dtype=np.int64)
        for b in tidy(slices(batches, "sketch")):
            for doc, h1, h2, bound in bounded(b):
                held.append(rows(doc, h1, h2, bound, bound >= floor))
                if sum(len(x[0]) for x in held) > 4 * PROBES * many:
                    held = [_highest_of(held)]
                    ends = np.searchsorted(held[0][0], np.arange(many), "right") - 1
                    full = np.bincount(held[0][0], minlength=many) == PROBES
                    floor[full] = held[0][4][ends[full]]
        if held:
            yield given(*_highest_of(held))

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "sketch")):
            for doc, h1, h2, bound in bounded(b):
                yield given(*rows(doc, h1, h2, bound, (bound > 0) & ((bound > least) | (bound == least) & (doc[:, None] <= last))))

    return index.sketches.mapInArrow(highest if least is None else reaching, FOUND)


def _scored(docs: DataFrame, found: DataFrame, block: Block, text_col: str, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """item, doc_id, score: the best k of the found documents for each item, and what that rests on."""
    # of equal texts only the k smallest ids matter; Spark limits each task's rows before it shuffles them
    same = Window.partitionBy("item", "h1", "h2").orderBy(F.col("doc_id").asc_nulls_last())
    found = written(found.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k).drop("nth", "bound"), "found")
    wanted = written(found.groupBy("h1", "h2").agg(F.collect_set("item").alias("items")), "wanted")
    texts = docs.select(F.col(text_col).alias("text"), *_text_keys(text_col)).where("text is not null")
    texts = with_flag(texts, F.col("h1"), wanted, "h1", "wanted").where("wanted").groupBy("h1", "h2").agg(F.first("text").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "text")):
            rows = []
            for h1, h2, text, items in zip(*(c.to_pylist() for c in b.columns)):
                counts = Counter(terms(text))
                m = int(block.lengths(np.array([counts.total()]))[0])
                rows += [(h1, h2, i, block.score(counts, i, m)) for i in items]
            cols = [*zip(*rows)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["h1", "h2", "item", "score"])

    exact = texts.join(wanted, ["h1", "h2"]).select("h1", "h2", "text", "items").mapInArrow(score, "h1 long, h2 long, item int, score long").where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.join(exact, ["h1", "h2", "item"]).withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"), [found, wanted]


def search(index: Index, docs: DataFrame, queries: DataFrame, k: int = 10, doc_text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    kind = queries.schema[item_col].dataType.simpleString()
    asked = written(_asked(queries, index, item_col, item_text), "asked")
    parts = []
    for block in _blocks(asked, index):
        probed, used = _scored(docs, _highest(_looked_up(index, block)), block, doc_text, k)
        ends = {r.item: (r.score, LAST if r.doc_id is None else r.doc_id) for r in probed.where(F.col("rank") == k).collect()}  # a row an item of the block
        removed(*used)
        least, last = np.array([ends.get(i, (0, LAST)) for i in range(len(block.items))], dtype=np.int64).T
        best, used = _scored(docs, _looked_up(index, block, least, last), block, doc_text, k)
        best = written(best, "ranked")
        removed(*used)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kind}")
        parts.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    removed(asked)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _highest(found: DataFrame) -> DataFrame:
    """The PROBES highest bounds of each item, of what tasks found."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= PROBES).drop("_rank")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """build() and search() in one, for one batch of queries; the index goes once the result is written."""
    index = build(docs)
    out = search(index, docs, queries, k)
    removed(index.sketches, index.frequencies)
    return out
