"""Byte-level BPE encoding and decoding of documents with a sentencepiece model made from a public vocabulary.

The model is serialised here, straight from the vocabulary's ranks: each token's bytes become characters, one for each
byte, a piece's score is its negative rank, and texts are not normalised, so that the pair of pieces that sentencepiece
joins next is the one of the lowest rank, the leftmost of equal ones.  Piece ids are ranks.  A text is cut by the public
pattern into pre-tokens, whose bytes are mapped in the same way and encoded one by one; tokens that merging does not reach
are looked up whole, as the reference library does.  Decoding maps the pieces' characters back to bytes.

Each worker process builds the model once.  Pre-tokens seen before come from a table of bounded size, and a long text goes
through in pieces of PIECES pre-tokens, in constant stack.

Defined results: a null or empty text has no ids and decodes to no bytes; a text of any length is encoded as a whole, also
one of white space only, of one letter or without any; repeated rows and null ids are rows like others; strings of special tokens
are ordinary text; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy

#: Pre-tokens encoded at a time, pre-tokens remembered, and the longest that is.
PIECES, REMEMBERED, REMEMBERED_LENGTH = 1 << 14, 1 << 18, 32
#: No piece of a model has this character.
BETWEEN = "\n"
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType(), False)])


def vocabulary_path() -> str:
    """Where each machine finds the vocabulary: the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where Latin-1 has a visible one, else the next one from code point 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """A field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks (0 to n-1, each once); the unknown piece, which byte-mapped text never meets, is n."""
    # fixed values of the format: fields of a piece (1 text, 2 score, 3 kind), of the trainer's (3 kind of model, 40-43 special ids)
    # and the normaliser's settings (1 name, 3 prefix, 4 white space, 5 escapes); kinds 1 normal, 2 unknown; model 2 is BPE
    characters = byte_characters()
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0 to n-1, each once")
    pieces = [_field(1, "".join(characters[b] for b in t)) + _field(2, -float(r)) + _field(3, 1) for r, t in enumerate(tokens)]
    pieces.append(_field(1, "<unk>") + _field(2, -float(len(tokens))) + _field(3, 2))
    none = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def _class_of(inner: str) -> np.ndarray:
    """The code points that tiktoken takes for a class of its expressions."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    found = bytes(tiktoken.Encoding("class", pat_str=inner, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
    return np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def _ranges(at: np.ndarray) -> str:
    cuts = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])])) if len(at) else ""


class Cut:
    """Cuts texts into pre-tokens.  Which characters are letters, numbers or white space differs by the Unicode version of a
    library: a text with a character that Python's regex takes otherwise than tiktoken is cut with the classes spelt out."""

    def __init__(self, pattern: str):
        names = (r"\p{L}", r"\p{N}", r"\s")
        own = [_class_of(n) for n in names]
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        theirs = [np.frombuffer("".join(regex.findall(n, every)).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) for n in names]
        odd = np.unique(np.concatenate([np.setxor1d(a, b) for a, b in zip(own, theirs)]))
        self.odd = re.compile(f"[{_ranges(odd)}]") if len(odd) else None
        self.plain = regex.compile(pattern)
        letters, numbers, spaces = map(_ranges, own)
        for shorthand, spelt in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
            pattern = pattern.replace(shorthand, spelt)
        self.spelt = re.compile(pattern)

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, PIECES at a time."""
        own = self.spelt if self.odd and not text.isascii() and self.odd.search(text) else self.plain
        if len(text) <= PIECES:
            yield own.findall(text)
            return
        found = own.finditer(text)
        while part := [m[0] for m in islice(found, PIECES)]:
            yield part


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(ranks))
        self.cut, self.unknown = Cut(pattern or public_tokenizers.PATTERN), len(ranks)
        characters = byte_characters()
        self.to_characters = {b: c for b, c in enumerate(characters)}
        back = {ord(c): b for b, c in enumerate(characters)}
        # by the inverse mapping of the model's own pieces
        self.bytes_of = [self.model.id_to_piece(i).translate(back).encode("latin-1") for i in range(len(ranks))]
        # tokens that merging does not reach from their bytes
        mapped = [self.model.id_to_piece(i) for i in range(len(ranks))]
        self.whole = {p: i for i, (p, ids) in enumerate(zip(mapped, self.model.encode(mapped, num_threads=1))) if ids != [i]}
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pre-tokens in one call: between them stands the unknown piece, over which nothing merges."""
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_characters) for p in pieces]
        ids = np.array(self.model.encode(BETWEEN.join(mapped)), dtype="<u4")
        raw, gap = ids.tobytes(), np.flatnonzero(ids == self.unknown) * 4
        ids = (raw[a:b] for a, b in zip([0, *(gap + 4).tolist()], [*gap.tolist(), len(raw)]))
        self.known.update(zip(pieces, ids))
        if self.whole:
            self.known.update((p, struct.pack("<I", self.whole[m])) for p, m in zip(pieces, mapped) if m in self.whole)

    def _ids(self, parts: list[list[str]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        if new := [*set().union(*parts).difference(self.known)]:
            self._learn(new)
        out = [b"".join(map(self.known.__getitem__, part)) for part in parts]
        for p in new:
            if len(p) > REMEMBERED_LENGTH:
                del self.known[p]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, each in four bytes, the lowest first.  Short texts are encoded together, a long one by itself."""
        short = [t if t and len(t) <= PIECES else "" for t in texts]
        out = self._ids([[*self.cut(t)][0] if t else [] for t in short])
        for i, t in enumerate(texts):
            if t and not short[i]:
                out[i] = b"".join(self._ids([part])[0] for part in self.cut(t))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def codec(path: str, pattern: str | None = None) -> Codec:
    """One for each worker process, however many tasks it runs."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of each text as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary or vocabulary_path(), pattern).encode
        for b in tidy(slices(batches, "text")):
            ids = encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ENCODED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decoded(rows: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded()'s rows with the bytes that their ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary or vocabulary_path(), pattern).decode
        for b in tidy(slices(batches, "ids")):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decode(x.as_py()) for x in b.column(2)], pa.binary())], DECODED.names)

    return rows.select(*ENCODED.names).mapInArrow(run, DECODED)
