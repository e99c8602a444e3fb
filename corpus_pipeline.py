"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Defined results: null texts, and texts without a letter, end at the first stage; empty tables give no rows; repeated
rows are one document from the third stage on; texts of any length are taken whole; columns of documents besides id,
text, language and length are passed on whatever their names; ties are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, langid, line_dedup, ngram_jaccard, packing
from ledgerloom.llm.common import doc_key, removed, set_aside, table, with_flag, written

#: A text that its best language model codes in so many bits a byte is in no learned language: texts of a learned one take 2 to 4.
RAW_BITS = 6.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that are null, have no letter, or are hardly shortened by any learned language."""
    own, back = set_aside(docs, "doc_id", "text", "lang")
    found = langid.identify(own)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") < RAW_BITS)).select(*back)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks that an earlier document holds; a document of which nothing is left goes."""
    own, back = set_aside(docs, "doc_id", "text", "n_chars")
    edited = line_dedup.dedup_lines(own).where((F.col("_lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return edited.withColumn("n_chars", F.length("text").cast("long")).select(*back) if "n_chars" in docs.columns else edited.select(*back)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingles the one with the smallest id stays; equal rows stay once."""
    own, back = set_aside(docs, "doc_id", "text")
    joined = ngram_jaccard.join_similar(own)
    found = joined.groupBy("key").agg(F.bool_or(F.col("key") == F.col("group_id")).alias("first"), F.count(F.lit(1)).alias("rows"))
    found = written(found.where("not first or rows > 1"), "copies")  # the keys that go, and those that stand more than once
    removed(*joined.rests_on)
    keyed = own.withColumn("_key", doc_key("doc_id", "text")).withColumn("_mark", F.xxhash64("text"))
    keyed = with_flag(keyed, F.xxhash64("_key"), found.select(F.xxhash64("key").alias("hash")), "hash", "_copies")
    rest = keyed.where("_copies").join(found.where("not first").select(F.col("key").alias("_key")), "_key", "left_anti").dropDuplicates(["_key", "_mark"])
    return keyed.where("not _copies").unionByName(rest).select(*back)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    own, back = set_aside(docs, "doc_id", "text")
    found = decontaminate.find_overlaps(own, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("overlaps") == 0).select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: SQL has no PPM, patience diff, MinHash or tokenizer; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
