"""Encoding with a public byte-level BPE vocabulary, by a sentencepiece model that is written from the vocabulary itself."""

from __future__ import annotations

import base64
import struct
from array import array
from collections import ChainMap
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of all functions here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits a text before any merge.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens of which one worker keeps the ids, and the length of those that it does.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Texts that are split before their new pre-tokens go to the model together.
BATCH = 256


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(directory: str = TOKENIZERS, name: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    pairs = (line.split() for line in Path(directory, name).read_bytes().splitlines() if line)
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(tag: int, value: bytes | str | int | float) -> bytes:
    """A field of a protocol-buffer message in wire format."""
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(tag << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else value
    return _number(tag << 3 | 2) + _number(len(data)) + data


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """A serialized sentencepiece BPE model with the same ids and merges.

    Each piece is spelled in byte letters, so any byte string is text to sentencepiece. A merge's score is its negative rank:
    the best-scored neighbours merge first, just as the lowest rank does. Nothing is normalized, prefixed or escaped. The
    piece for unknown characters, which the format requires, gets the id behind all others and can't occur.
    """
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, "".join(letters[b] for b in p)) + _field(2, float(-rank)) + _field(3, normal)) for rank, p in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    none = (1 << 64) - 1
    out.append(_field(2, _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Texts to ids and back. Made once in a worker process."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self.split = regex.compile(PRE_TOKENS).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = byte_letters()
        self.table = dict(enumerate(self.letters))
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.known: dict[str, list[int]] = {}

    def _split_known(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, list[int]]]:
        """The pre-tokens of each text, and the ids of at least all of them. New ones go to the model in one call."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        tokens = [self.split(t) if t else [] for t in texts]
        new = [t for t in dict.fromkeys(chain.from_iterable(tokens)) if t not in self.known]
        if not new:
            return tokens, self.known
        made = dict(zip(new, self.model.encode([t.encode().decode("latin-1").translate(self.table) for t in new], num_threads=1), strict=True))
        self.known.update((t, i) for t, i in made.items() if len(t) <= LONGEST_REMEMBERED)
        return tokens, ChainMap(made, self.known) if any(len(t) > LONGEST_REMEMBERED for t in new) else self.known

    def encode(self, text: str | None) -> list[int]:
        """The ids of the whole text; strings of special tokens are ordinary text. Empty for an empty and for a null text."""
        tokens, ids = self._split_known([text])
        return [i for t in tokens[0] for i in ids[t]]

    def encode_all(self, texts: list[str | None]) -> tuple[array, array]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        flat, offsets = array("i"), array("i", [0])
        tokens, ids = self._split_known(texts)
        for own in tokens:
            for t in own:
                flat.extend(ids[t])
            offsets.append(len(flat))
        return flat, offsets

    def count_all(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        tokens, ids = self._split_known(texts)
        return [sum(map(len, map(ids.__getitem__, own))) for own in tokens]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no text (of part of a character) become U+FFFD."""
        return bytes(self.bytes[c] for i in ids for c in self.model.id_to_piece(int(i))).decode(errors="replace")


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a broadcast model, made on first use in this process."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast model with an id that workers can tell it by. Its size is that of the vocabulary file, whatever the data."""

    def __init__(self, spark: SparkSession, directory: str, name: str) -> None:
        self.broadcast = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(directory, name)))
        self.id = f"{directory}/{name}"

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def token_ids(spark: SparkSession, c: Column, directory: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """The ids of a text column as array<int>."""
    shared = _Shared(spark, directory, name)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec, rows, parts = _codec(shared), texts.to_pylist(), []
        for i in range(0, len(rows), BATCH):
            flat, offsets = codec.encode_all(rows[i : i + BATCH])
            parts.append(pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(c)


def token_count(spark: SparkSession, c: Column, directory: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """The number of ids of a text column; 0 for an empty and for a null text."""
    shared = _Shared(spark, directory, name)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        codec, rows = _codec(shared), texts.to_pylist()
        return pa.array([n for i in range(0, len(rows), BATCH) for n in codec.count_all(rows[i : i + BATCH])], pa.int32())

    return count(c)


def ids_text(spark: SparkSession, c: Column, directory: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """The text of a column of ids; null for null."""
    shared = _Shared(spark, directory, name)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return ids.map(lambda x: None if x is None else codec.decode(x))

    return decode(c)
