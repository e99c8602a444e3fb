"""The Merkle manifest, byte-level BPE and lexical search against plain Python, on messy, empty and very long input."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from ledgerloom.llm import byte_bpe, lexical, merkle, packing
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n, words="alpha Beta gamma delta Epsilon zeta eta theta iota kappa".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


def messy_rows():
    rng = random.Random(9)
    base = [(i, text(rng, rng.randrange(1, 40)), rng.choice(["en", "fr", "É", None, "zz"]), rng.choice(["s", None]), rng.choice([i, None])) for i in range(150)]
    return base + [base[3], base[3], base[40], (None, base[4][1], None, None, None), (None, None, "en", "s", None), (200, "", "en", "s", 0), (201, None, None, None, None), (7, "Other", "en", "s", 3), (202, text(rng, 20_000), "en", "s", 4), (203, "\n \t!!", "only", "s", 4)]


def clashing(df):
    for c in ("key", "place", "part", "seq", "leaf", "node", "item", "h1", "h2", "n", "sketch", "ids", "Term", "_rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def messy(spark):
    return clashing(spark.createDataFrame(messy_rows(), DOC))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 11: Merkle manifest


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lowered(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def proofs(rows):
    """The query's rows by plain lists."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf(*r) for r in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    for rank, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded, proof = leaf(r[0], lowered(r[1]) if altered else r[1], *r[2:]), ""
            for tree, at in ((trees[lang], i), (top, rank)):
                for level in tree[:-1]:
                    run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    folded, at = digest("".join([*run[:slot], folded, *run[slot + 1 :]])), at // 8
            yield r[0], leaf(*r), trees[lang][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_of_messy_rows(spark, messy):
    assert in_order(merkle.tamper_check(messy).collect()) == in_order(proofs(messy_rows()))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_sizes(spark, n):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(n)]
    assert in_order(merkle.tamper_check(spark.createDataFrame(rows, DOC)).collect()) == in_order(proofs(rows))


def test_many_languages_and_blocks(spark, monkeypatch):
    """More trees than a run holds, one of them with most rows, and nodes that are stored for several blocks."""
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"Text {i}", "big" if i % 3 else f"l{i % 75}", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOC)
    assert in_order(merkle.tamper_check(docs).collect()) == in_order(proofs(rows))
    m = merkle.manifest(docs)
    most = m.leaves.groupBy("node", F.floor(F.col("place") / 16)).count().agg(F.max("count")).first()[0]
    assert most <= 16 and m.nodes.groupBy("id").count().agg(F.max("count")).first()[0] > 10


def test_manifest_finds_each_change(spark, messy):
    """An unaltered table folds to its root; a change of any field in any row does not."""
    assert {r.verified for r in merkle.verified(merkle.manifest(messy)).collect()} == {True}
    for change in ({"n_chars": F.coalesce("n_chars", F.lit(0)) + 1}, {"source": F.lit("other")}, {"text": F.concat(F.coalesce("text", F.lit("")), F.lit(" "))}):
        assert {r.verified for r in merkle.verified(merkle.manifest(messy, F.lit(True), **change)).collect()} == {False}


def test_recursion_setting_is_put_back(spark, messy):
    before = spark.conf.get(merkle.RECURSION_ROWS)
    merkle.climb(merkle.manifest(messy))
    assert spark.conf.get(merkle.RECURSION_ROWS) == before


def test_manifest_of_nothing(spark, empty):
    assert merkle.tamper_check(empty).collect() == []


# --- 12: byte-level BPE


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(byte_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_every_token_and_character(own, reference):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert own.encode([every]) == [packed(reference.encode_ordinary(every))]
    assert own.decode(packed(range(own.unknown))) == b"".join(reference.decode_single_token_bytes(i) for i in range(own.unknown))


def test_ids_equal_tiktoken(own, reference):
    rng = random.Random(4)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "12", "é", "ß", "漢字", "͸", "\U00031350", " ", "!", "\x00", "\x1c", "\x85", "<|endoftext|>", "༳"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["", None]
    assert own.encode(texts) == [packed(reference.encode_ordinary(t or "")) for t in texts]


@pytest.mark.parametrize("s", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "." * 2_000_000, " \n\t" * 600_000 + "x", "word " * 400_000])
def test_very_long_texts(own, s):
    ids = own.encode([s])[0]
    assert own.decode(ids) == s.encode()
    assert np.frombuffer(ids, dtype="<u4").tolist() == packing.ids_of(s)  # which takes what ends tiktoken to tokenizers


def test_long_runs_below_tiktokens_limit(own, reference):
    for s in (" " * 90_000 + "x", "\n" * 90_000, " x" + "\t" * 50_000 + "y"):
        assert own.encode([s])[0] == packed(reference.encode_ordinary(s)) == packed(packing.ids_of(s))


def test_tokens_that_merging_does_not_reach(tmp_path):
    """A vocabulary with a token whose parts are in no other token: found whole only."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"xyz"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    odd = byte_bpe.Codec(str(path))
    ranks = {t: i for i, t in enumerate(tokens)}
    reference = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for s in ("xyz", " xyz", "abxyz", "ab xyz!xyz", "xyzxyz"):
        assert odd.encode([s])[0] == packed(reference.encode_ordinary(s)), s


def test_little_memory_of_pre_tokens(own, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(byte_bpe, "PIECES", 7)
    rng = random.Random(6)
    texts = [text(rng, rng.randrange(30)) for _ in range(50)]
    assert own.encode(texts) == [packed(reference.encode_ordinary(t)) for t in texts]


def test_encoded_and_decoded_frames(spark, messy, empty, reference):
    rows = byte_bpe.decoded(byte_bpe.encoded(messy)).collect()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows), key=repr)
    assert got == sorted(((r[0], len(i := reference.encode_ordinary(r[1] or "")), packed(i), (r[1] or "").encode()) for r in messy_rows()), key=repr)
    assert byte_bpe.decoded(byte_bpe.encoded(empty)).collect() == []


# --- 5: packing, on what ends tiktoken


def test_packing_of_long_white_space(spark):
    texts = [" " * 2_000_000, "\n" * 1_500_000, "a b " + " \t" * 700_000 + " c", "short"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    slow = packing._slow_encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    for d, t in enumerate(texts):
        ids = packed([*slow.encode(t, add_special_tokens=False).ids, packing.END_ID])
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert sum(r.length for r in own) * 4 == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)


# --- 13: ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(lowered(t or ""))


def ranked(docs, items, k=10):
    counted = [(d, c) for d, t in docs if (c := Counter(terms(t)))]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, own in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own if df[t]}
        scores = []
        for d, c in counted:
            m = 10 + 90 * c.total() * n_docs // total
            scores.append((-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in w if c[t]), d is None, d))
        best = sorted((x for x in scores if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        yield from ((i, r + 1, x[2], -x[0]) for r, x in enumerate(best))


def test_search_of_messy_rows(spark, messy):
    rng = random.Random(2)
    items = [(i, text(rng, 12)) for i in range(20)] + [(3, text(rng, 3)), (None, "alpha1"), (30, None), (31, "nothing of it"), (32, "!!")]
    queries = clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = ranked([r[:2] for r in messy_rows()], items)
    assert in_order(lexical.rank_documents(messy, queries).collect()) == in_order(want)


def test_terms_are_runs_of_the_pattern():
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice(["a", "Z", "É", "é", "İ", "-", "_", " ", "\x00", "\x85", " ", "9", "漢", "\x7f", "{", "`", "@"]) for _ in range(30))
        assert [x.decode() for x in lexical.terms(t)] == terms(t)


@pytest.mark.parametrize("terms_a_block", [1 << 18, 9])
def test_blocks_copies_and_many_occurrences(spark, monkeypatch, terms_a_block):
    """A group of copies and near copies, more than 255 occurrences of a term, ties, and queries in several blocks."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms_a_block)
    rng = random.Random(12)
    docs = [(i, "same words in all of these copies") for i in range(400)] + [(1000 + i, f"same words in nearly all of these copies {i % 7}") for i in range(300)]
    docs += [(2000 + i, text(rng, 60)) for i in range(300)] + [(3000, "alpha1 " * 700), (3001, "alpha1 " * 300 + "beta2"), (3002, "alpha1")]
    rng.shuffle(docs)
    items = [(0, "same copies"), (1, "nearly 3"), (2, "alpha1 beta2"), (3, "words alpha1 zeta9 kappa20 eta3"), (4, "alpha1 " * 5)]
    got = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert in_order(got.collect()) == in_order(ranked(docs, items))


def test_bounds_hold_and_prune(spark):
    """No score is above its bound, and few documents are scored."""
    rng = random.Random(3)
    docs = [(i, text(rng, rng.randrange(10, 300), [f"w{j}" for j in range(400)])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(i, text(rng, 15, [f"w{j}" for j in range(400)])) for i in range(10)]
    queries = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(df)
    (block,) = lexical._blocks(lexical._asked(queries, index, "item_id", "text"), index)
    everything = lexical._looked_up(index, block, np.zeros(10, dtype=np.int64), np.zeros(10, dtype=np.int64))
    bounds = {(block.items[r.item], r.doc_id): r.bound for r in everything.collect()}
    exact = {(i, d): s for i, _, d, s in ranked(docs, items, 10**9)}
    assert all(bounds[x] >= s for x, s in exact.items())
    least = {i: s for i, r, _, s in ranked(docs, items) if r == 10}
    assert sum(b >= least[i] for (i, _), b in bounds.items()) < 0.2 * len(docs) * len(items)


def test_search_of_nothing(spark, empty, messy):
    items = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert lexical.rank_documents(empty, items).collect() == []
    assert lexical.rank_documents(messy, items.where("false")).collect() == []
