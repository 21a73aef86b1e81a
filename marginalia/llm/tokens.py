"""Encoding with a public byte-level tokenizer by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so every encoding has
a token boundary there. Text is cut at such pairs and where the split pattern cuts anyway; the fragments, mostly
single words, are encoded independently and their ids concatenated. Fragments repeat, so a bounded dictionary of
fragments answers nearly all of them without running the merges again.

Why a cut before position i is certain. Let a be the byte before it and b the byte after it, a the end of a
character that is no white space, b the beginning of one that is no apostrophe.
- The pattern's pieces are runs of one class (letters, numbers, other signs; a space may lead them), contractions, and
  runs of white space. If b begins white space, a piece ends at i in the whole text. If not, either a piece ends
  at i or a run of one class goes over i; then, as the pair is in no token, no merge goes over i, and the merges
  on its two sides are those of either side alone.
- What follows i is split as in the whole text: the rest of a run is a run of the same class, only an apostrophe could open a
  contraction there. What precedes i is split as in the whole text: only white space looks ahead.
- No contraction is cut, as all are tokens (checked for each vocabulary).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.runtime import spread

#: Split pattern of the 50k vocabularies (fixed value of the public tokenizer), a parameter for others of its form.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Folder of the vocabulary files, a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fragments held by one encoder; beyond it the dictionary starts anew (memory only, never the result).
MEMO = 400_000
#: Bytes of the longest fragments that are held.
LONG = 64

# The beginnings of white space in ASCII, and the contractions of the pattern.
_ASCII_SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]
_CONTRACTIONS = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]
_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


class Encoder:
    """Ids of texts by the ranks of ``{folder}/{name}.tiktoken``, without special tokens."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.direct = tiktoken.Encoding("forced", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        #: pair (a, b) of bytes that no token holds side by side
        self.forced = ~inside
        if any(self.forced[c[k], c[k + 1]] for c in _CONTRACTIONS for k in range(len(c) - 1)):
            raise ValueError(f"{name} cuts contractions; its forced boundaries are not certain")
        #: pairs with a cut between them, if what ends with a is no white space: white space follows, or the pair is forced
        self.cuts = self.forced.copy()
        self.cuts[:, _ASCII_SPACES] = True
        self.cuts[_ASCII_SPACES] = False
        self.cuts[:, 0x80:0xC0] = False  # within a character
        self.cuts[0xC0:] = False
        self.cuts[:, 0x27] = False
        self._flat = self.cuts.ravel()
        self.memo: dict[bytes, bytes] = _Memo(self._fragment)

    def _fragment(self, fragment: bytes) -> bytes:
        return np.array(self.direct.encode_ordinary(fragment.decode()), np.int32).tobytes()

    def certain(self, raw: bytes) -> np.ndarray:
        """The positions of certain cuts in the UTF-8 bytes of a text."""
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self._flat[(b[:-1].astype(np.uint16) << np.uint16(8)) | b[1:]]) + 1
        if len(at) and not raw.isascii():
            ends = [i for i in at[b[at - 1] >= 0x80].tolist() if raw[max(0, i - 3) : i].endswith(tuple(_SPACES))]
            at = np.setdiff1d(at, ends, assume_unique=True)
        return at

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as the bytes of 32-bit integers; none for an empty or a null text."""
        if not text:
            return b""
        try:
            raw = text.encode()
        except UnicodeEncodeError:  # single halves of surrogate pairs are no characters
            raw = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
        at = self.certain(raw).tolist()
        return b"".join(map(self.memo.__getitem__, [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]))


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
        return value


_encoders: dict[tuple[str, str, str], Encoder] = {}


def encoder(folder: str, name: str, pattern: str = PATTERN) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (folder, name, pattern) not in _encoders:
        _encoders[folder, name, pattern] = Encoder(folder, name, pattern)
    return _encoders[folder, name, pattern]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row.

    A null and an empty text give an empty list; a null id stays null; repeated rows stay repeated; other
    columns, whatever their names, are not read. Strings of special tokens are ordinary text. Narrow: no
    shuffle, except to fill idle cores where a table has fewer splits than the session has cores.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name, pattern)
        for batch in batches:
            coded = [enc.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int64)
            np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    rows = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and ``n_tokens`` (int, 0 for empty and null texts) of every row, as ``encode_texts`` counts them."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name, pattern)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) // 4 for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["id", "n_tokens"])

    rows = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens int").withColumnRenamed("id", id_col)
