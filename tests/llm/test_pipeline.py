"""The pipeline against a plain-Python version of its stages."""

import collections

import corpus_pipeline
import numpy as np
from ledgerloom.llm import decontaminate, langid
from pyspark.sql import functions as F
from test_line_dedup import brute
from test_llm import grams, linked, reach


def test_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf).persist()
        kept[name] = frame.collect()
        if name != names[-1]:
            assert frame.columns == docs.columns
    pred = {r.doc_id: r for r in langid.identify(docs).collect()}
    first = {r.doc_id: r.text for r in docs.collect() if pred[r.doc_id].lang_pred != "und" and pred[r.doc_id].bits_per_byte < corpus_pipeline.RAW_BITS}
    assert {r.doc_id: r.text for r in kept["language_id"]} == first
    lines = brute(list(first.items()))
    got = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert {i: [x for x in t.split("\n") if x.strip()] for i, t in got.items()} == {i: x for i, x in lines.items() if x}
    order = sorted(got)
    root = reach(len(order), linked([grams(got[i]) for i in order]))
    assert {r.doc_id for r in kept["ngram_jaccard"]} == {i for k, i in enumerate(order) if root[k] == k}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    clean = set()
    for r in kept["ngram_jaccard"]:
        w = grams_of(r.text)
        if not any(hit(w, grams_of(b.text)) for b in bench):
            clean.add(r.doc_id)
    assert {r.doc_id for r in kept["decontamination"]} == clean
    ends = collections.Counter()
    for r in kept["packing"]:
        ends[r.sequence_id] += r.length
    assert {r.doc_id for r in kept["packing"]} == clean and max(ends.values()) <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept["packing"])


def test_clashing_columns_and_messy_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ("score", "lang_pred", "bits_per_byte", "_lines_removed", "overlaps", "_key", "_mark", "_text", "key", "node", "_passed0", "item")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, None, "en", "s", None), (900003, "12 !!", None, None, None), (900004, "word " * 30_000, "en", "s", 1)], docs.schema)
    one = docs.where("text is not null").orderBy("doc_id").limit(1)
    whole = docs.unionByName(odd).unionByName(one).withColumns({c: F.lit("clash") for c in names})
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, kept = whole, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf).persist()
        assert frame.columns == whole.columns and frame.where(" or ".join(f"{c} <> 'clash'" for c in names)).count() == 0
        kept[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    assert not kept["language_id"] & {None, 900001, 900002, 900003}
    got = corpus_pipeline.run(spark, str(tmp_path))
    plain = corpus_pipeline.run(spark, sf)
    same = lambda df: sorted(map(tuple, df.where("doc_id is null or doc_id <> 900004").select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert same(got) == same(plain)


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        assert frame.count() == 0


def grams_of(t):
    import re

    return np.array([hash(w) for w in re.findall(r"\w+", (t or "").lower())])


def hit(doc, item, share=0.8):
    """Whether some diagonal has a long enough stretch with enough equal words; every diagonal and stretch is tried."""
    need = min(decontaminate.MIN_WORDS, len(item))
    for d in range(-len(item) + 1, len(doc)):
        a, b = max(0, d), min(len(doc), d + len(item))
        equal = doc[a:b] == item[a - d : b - d]
        if need == 0 or equal.sum() < need * share:
            continue
        if any(equal[x:y].mean() >= share for x in range(len(equal)) for y in range(x + need, len(equal) + 1)):
            return True
    return False
