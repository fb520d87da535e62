"""Encoding of texts with a public byte-level BPE, by a sentencepiece model made from its vocabulary."""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from websift.llm.langid import TOKENIZERS

# Fixed value: how the vocabulary's tokenizer cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next unused one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


def ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """The vocabulary: bytes of each token and its id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """A field in the protocol buffer wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def serialise(vocabulary: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece k + 1 the byte-mapped token of rank k with score -k; identity normalisation, no added or escaped blanks."""
    chars = byte_characters()
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chars[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1)))
    # Trainer: BPE, size, no byte fallback, ids of unknown and of the absent begin, end and padding.
    out.append(_field(2, _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(35, 0) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, "identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Encoder:
    """Encodes and decodes; ids of distinct pre-tokens are kept, up to most of them."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 300_000) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(vocabulary))
        self.pre = regex.compile(PATTERN)
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.back = {c: b for b, c in self.map.items()}
        self.ids = {r: b for b, r in vocabulary.items()}
        #: Piece k of the model is the k-th lowest rank.
        self.rank_of = np.array([-1, *sorted(vocabulary.values())])
        self.known: dict[str, list[int]] = {}
        self.most = most

    def learn(self, words: list[str]) -> None:
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for w in words]
        for w, ids in zip(words, self.model.EncodeAsIds(mapped, num_threads=1) if mapped else [], strict=True):
            self.known[w] = self.rank_of[ids].tolist()

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text without special tokens; an empty list for a null or empty text. Special strings are ordinary text."""
        if len(self.known) > self.most:
            self.known = {}
        found = [self.pre.findall(t) if t else [] for t in texts]
        self.learn([w for w in dict.fromkeys(w for f in found for w in f) if w not in self.known])
        known = self.known
        return [[i for w in f for i in known[w]] for f in found]

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse: bytes of the ids, joined."""
        return b"".join(self.ids[i] for i in ids).decode("utf-8", "surrogatepass")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of this process."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = Encoder(ranks(folder, name))
    return _ENCODERS[folder, name]


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType())])
#: Texts are taken in portions of about so many characters, so that long texts do not pile up in memory.
PORTION = 2_000_000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str | None]]]:
    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size > PORTION:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids: one row for each row of documents; null and empty texts have an empty list. No shuffle.

    Texts of any length are encoded whole. Rows with a null doc_id and repeated rows stay as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for ids, texts in _portions(batches):
            made = e.encode(texts)
            offsets = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int32)
            flat = np.fromiter((i for m in made for i in m), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, IDS)


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and the columns named in also; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            counts = [len(m) for _, texts in _portions([b]) for m in e.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *b.columns[2:]], ["doc_id", "n_tokens", *also])

    schema = T.StructType([*COUNTS, *[documents.schema[c] for c in also]])
    return documents.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(run, schema)
