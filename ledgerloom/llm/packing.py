"""Best-fit packing of tokenised documents into sequences, by exact complements.

Documents longer than a sequence are cut into whole sequences, with the shorter piece first.  The plan is
made on the histogram of piece lengths, which has at most CAPACITY entries however many documents there
are.  From the longest length down: the gap that a piece leaves is filled exactly by one, two or three
lengths, looked up in indexes of single, pair and triple sums and checked against the counts left; where no
such combination exists the longest length that fits goes in and the search goes on with the rest of the
gap.  A filled pattern is repeated as often as its counts allow, so each step uses up at least one length
and there are at most CAPACITY patterns.

Pieces of equal length are interchangeable: each piece gets its rank among them (numbered in buckets of at
most 1/RANK_SHARE of all rows, with a bounded table of offsets), and the plan maps (length, rank) to a place.

Token ids: byte-level BPE by a public vocabulary, and the end id after each document, computed by `tiktoken` from
the vocabulary's rank file; they equal those of `tokenizers` with the vocabulary's JSON file where that takes
the strings of special tokens in a text as ordinary text, as this operator does.  A text with a run of SPACES white-space
characters or more, of which a million end `tiktoken`, is encoded by `tokenizers` itself.

Defined results: a null or empty text is the end id alone; a very long text is encoded as a whole and cut into
pieces; pieces of equal length are ranked by id, piece, place and checksum, and rows that are equal in all of
these are placed in any order; repeated rows are packed like any others; other columns of docs, whatever
their names, are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy, written

CAPACITY = 2048
END_ID = 0
RANK_SHARE = 4096
SPACES = 100_000
PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False)])


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where each machine finds the vocabulary: the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoder(path: str) -> tiktoken.Encoding:
    """One for each worker process, however many tasks it runs."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _slow_encoder(path: str) -> tokenizers.Tokenizer:
    out = tokenizers.Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def ids_of(text: str, vocabulary: str | None = None, vocabulary_json: str | None = None) -> list[int]:
    """The ids of a text, however it is made; the two files hold one vocabulary."""
    if len(text) >= SPACES and re.search(rf"(?<!\s)\s{{{SPACES}}}", text):
        return _slow_encoder(vocabulary_json or vocabulary_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    return _encoder(vocabulary or vocabulary_path()).encode_ordinary(text)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, vocabulary_json: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(slices(batches, "text")):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*ids_of(text or "", vocabulary, vocabulary_json), END_ID], dtype="<u4")
                short = len(ids) % capacity or capacity
                for n, start in enumerate([0, *range(short, len(ids), capacity)]):
                    part = ids[start : start + (capacity if start else short)]
                    rows.append((doc, n, start, len(part), zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


class SumIndex:
    """Which gaps one, two or three of the lengths at hand fill exactly."""

    def __init__(self, left: np.ndarray):
        self.left, n = left, 4 * len(left)
        self.one = left > 0
        f = np.fft.rfft(self.one, n)
        self.two = np.fft.irfft(f * f, n)[: len(left)] > 0.5
        self.three = np.fft.irfft(np.fft.rfft(self.two, n) * f, n)[: len(left)] > 0.5

    def _pair(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        if gap < 2 or not self.two[gap]:
            return None
        for a in np.flatnonzero(self.one[1:gap] & self.one[gap - 1 : 0 : -1])[::-1] + 1:
            pair = (int(a), gap - int(a))
            if self._left(pair, used):
                return pair
        return None

    def _left(self, lengths: tuple[int, ...], used: Counter) -> bool:
        return all(self.left[x] - used[x] >= lengths.count(x) for x in set(lengths))

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        if self.one[gap] and self._left((gap,), used):
            return (gap,)
        if pair := self._pair(gap, used):
            return pair
        if gap >= 3 and self.three[gap]:
            for a in np.flatnonzero(self.one[1 : gap - 1] & self.two[gap - 1 : 1 : -1])[::-1] + 1:
                if self.left[a] > used[int(a)] and (pair := self._pair(gap - int(a), used + Counter([int(a)]))):
                    return (int(a), *pair)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many sequences, [(length, times in each)]), for a histogram of lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    longest = capacity
    while longest:
        if not left[longest]:
            longest -= 1
            continue
        index, used, gap = SumIndex(left), Counter([longest]), capacity - longest
        while gap:
            if found := index.exact(gap, used):
                used.update(found)
                break
            fits = [x for x in np.flatnonzero(left[: gap + 1])[::-1] if left[x] > used[int(x)]][:1]
            if not fits:
                break
            used[int(fits[0])] += 1
            gap -= int(fits[0])
        many = int(min(left[x] // n for x, n in used.items()))
        for x, n in used.items():
            left[x] -= many * n
        out.append((many, sorted(used.items(), reverse=True)))
    return out


def _places(patterns) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, first offset), by length and first rank."""
    taken, rows, sequence = Counter(), [], 0
    for many, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], many, sequence, offset))
            taken[length] += many * times
            offset += length * times
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (tokenised's columns, materialised) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan(counts, capacity))
    bucket = max(500, sum(counts.values()) // RANK_SHARE)
    parts = F.lit([max(1, -(-counts.get(x, 0) // bucket)) for x in range(capacity + 1)])[F.col("length").cast("int")]
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts).cast("int"))
    sizes = sorted((r["length"], r["_b"], r["count"]) for r in rows.groupBy("length", "_b").count().collect())
    before, sums = [], Counter()
    for length, b, n in sizes:
        before.append((length, b, sums[length]))
        sums[length] += n
    keys = np.array([x << 32 | b for x, b, _ in before], dtype=np.int64)
    first = np.array([n for *_, n in before], dtype=np.int64)
    starts = places[:, 0] << 40 | places[:, 1]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")))
    names = PIECES.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_b", "_r"))
            rank = first[np.searchsorted(keys, length << 32 | part)] + r - 1
            row = places[np.searchsorted(starts, length << 40 | rank, side="right") - 1] if len(length) else places[:0]
            turn = rank - row[:, 1]
            many = np.maximum(row[:, 2], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(row[:, 3] + turn % many), pa.array(row[:, 4] + turn // many * length)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, vocabulary_json: str | None = None) -> DataFrame:
    return pack(written(tokenised(docs, id_col, text_col, vocabulary, capacity, vocabulary_json), "pieces"), capacity)
