"""Helpers shared by the corpus operators: shared storage, row keys and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only where all run in one process may it be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that written() made, once all that was derived from them is itself written."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key(doc_id: str, text: str) -> Column:
    """A long that names a document: its id, or for a null id a hash of its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], count: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """Join rows with the few rows of a key (small, materialised; `count` = rows of that key among `total`).

    A hot key's rows are dealt over several tasks by `spread` and its rows in `small` are repeated for each of them.
    The hot list is broadcast; by its definition it has at most HOT_SHARE keys.
    """
    least = max(1, total // HOT_SHARE)
    salt, many = free_name(rows, "_salt"), free_name(rows, "_parts")
    parts = F.ceil(F.col(count) / F.lit(least)).cast("int")
    hot = small.where(F.col(count) > least).select(*keys, parts.alias(many)).distinct()
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(many, F.lit(1))).cast("int")).drop(many)
    spread_small = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(count) > least, parts).otherwise(F.lit(1)) - 1)))
    return salted.join(spread_small.drop(count), [*keys, salt], how).drop(salt)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that come sorted by keys, each as one table; a group may run over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones under names that clash with nothing, and the columns that undo it."""
    names = {c: c if c in needed else free_name(docs, f"_passed{i}") for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def others(docs: DataFrame, *results: str) -> list[str]:
    """docs' columns but those that have a result's name: an operator's result replaces them."""
    taken = {r.lower() for r in results}
    return [c for c in docs.columns if c.lower() not in taken]


#: What Python makes of texts at a time: at most about so many bytes of text, or one text.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 512


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, by rows and by the bytes of the text column, so that what Python makes of them stays small."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, dtype=np.int64)
        if text is not None and batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            room = (ends[a - 1] if a else 0) + SLICE_BYTES
            b = min(a + rows, batch.num_rows) if text is None else min(a + rows, max(a + 1, int(np.searchsorted(ends, room, "right"))))
            yield batch.slice(a, b - a)
            a = b


#: A hash has two bits in a bitmap of 2 ** BITMAP_BITS.
BITMAP_BITS = 25


def bitmap_of(rows: DataFrame, hash_col: str) -> np.ndarray:
    """A set of hashes that may hold others too.  Spark combines the bits into at most 2 ** (BITMAP_BITS - 6) numbers,
    which the driver puts together, so the size is the same however many rows there are."""
    h = F.col(hash_col)
    bits = F.explode(F.array(F.shiftrightunsigned(h, 64 - BITMAP_BITS), h.bitwiseAND((1 << BITMAP_BITS) - 1))).alias("bit")
    parts = rows.select(bits).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[parts["at"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return out


def among(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be in the bitmap's set."""
    has = lambda bit: (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
    out = has(h >> np.uint64(64 - BITMAP_BITS))
    out[out] = has(h[out] & np.uint64((1 << BITMAP_BITS) - 1))
    return out


def with_flag(docs: DataFrame, h: Column, wanted: DataFrame, hash_col: str, flag: str, bits: int = 24) -> DataFrame:
    """docs with a flag: whether `wanted` may hold the hash h.  Texts of which nothing is to be joined stay where they are.

    The bitmap is a table of at most 2 ** (bits - 6) pairs of longs, however many rows `wanted` has, and so is broadcast.
    """
    split = lambda c: (F.shiftrightunsigned(c, 64 - bits), c.bitwiseAND((1 << bits) - 1))
    words = wanted.select(F.explode(F.array(*split(F.col(hash_col)))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    words = written(words, "bitmap")
    out, tests = docs, []
    for bit in split(h):
        at, has = free_name(out, "_at"), free_name(out, "_bits")
        out = out.withColumn(at, F.shiftright(bit, 6)).join(F.broadcast(words.select(F.col("at").alias(at), F.col("bits").alias(has))), at, "left").drop(at)
        tests.append(F.coalesce(F.call_function("shiftrightunsigned", F.col(has), bit.bitwiseAND(63).cast("int")).bitwiseAND(1) != 0, F.lit(False)))
    return out.withColumn(flag, tests[0] & tests[1]).select(*(F.col(f"`{c}`") for c in docs.columns), flag)


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session: texts are long, and the JVM builds a batch before Python can cut it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@cache
def _trim():
    """The C library's way to give freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives the memory of a finished task back, as workers outlive their tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        _trim()(0)
