"""Encoding of a corpus with a public byte-level BPE by monoid tree reduction.

A text is halved until a piece has at most ``LEAF`` characters; pieces are encoded, and neighbours are joined up the
tree. At a seam only a window is encoded again. It grows to both sides until it ends where a word piece must end
whatever stands farther off: between characters of unlike class, but for a sign before a letter and white space before
anything. The pattern never looks back and no alternative of it spans such a place, so ids outside the window stand;
decoding concatenates. Every text takes this way; one of ``LEAF`` characters or less is a tree of one leaf.
Null and empty texts have the empty list of ids. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern that splits texts into word pieces before byte-pair encoding.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
#: Places where a word piece ends whatever stands beyond the characters on both sides.
CERTAIN = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])")
_HELD: dict[str, tiktoken.Encoding] = {}


def encoder(name: str, path: str = TOKENIZERS) -> tiktoken.Encoding:
    """The encoder of ``<path>/<name>.tiktoken``, built once a process."""
    if name not in _HELD:
        with open(f"{path}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _HELD[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _HELD[name]


class Piece:
    """An encoded stretch of text."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]) -> None:
        self.text, self.ids = text, ids


def last_certain(text: str, width: int = 24) -> int:
    """The last certain place inside a text, 0 if there is none; the window searched grows."""
    while True:
        low = max(0, len(text) - width)
        places = [m.start() for m in CERTAIN.finditer(text, low) if low < m.start() < len(text)]
        if places or not low:
            return places[-1] if places else 0
        width *= 4


def first_certain(text: str, width: int = 24) -> int:
    """The first certain place inside a text, its length if there is none."""
    while True:
        found = next((m.start() for m in CERTAIN.finditer(text, 0, min(len(text), width)) if 0 < m.start() < min(len(text), width)), 0)
        if found or width >= len(text):
            return found or len(text)
        width *= 4


def join(enc: tiktoken.Encoding, left: Piece, right: Piece) -> Piece:
    """The encoding of both texts together: ids of the window around the seam are made anew."""
    if not left.text or not right.text:
        return right if not left.text else left
    a, b = last_certain(left.text), first_certain(right.text)
    tail, head = left.text[a:], right.text[:b]
    kept = left.ids[:len(left.ids) - len(enc.encode_ordinary(tail))]
    return Piece(left.text + right.text, kept + enc.encode_ordinary(tail + head) + right.ids[len(enc.encode_ordinary(head)):])


def tree(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> Piece:
    if len(text) <= leaf:
        return Piece(text, enc.encode_ordinary(text))
    half = len(text) // 2
    return join(enc, tree(enc, text[:half], leaf), tree(enc, text[half:], leaf))


def encode(enc: tiktoken.Encoding, text: str | None, leaf: int = LEAF) -> list[int]:
    """Ids of one text."""
    return tree(enc, text, leaf).ids if text else []


def with_ids(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k", path: str = TOKENIZERS, out: str = "ids") -> DataFrame:
    """Adds the ids of a text column."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(name, path)
        for texts in batches:
            yield pd.Series([encode(enc, t) for t in texts], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def with_sizes(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k", path: str = TOKENIZERS, out: str = "n_tokens") -> DataFrame:
    """Adds the number of ids of a text column; no list of ids leaves the worker."""

    @F.pandas_udf("bigint")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(name, path)
        for texts in batches:
            yield pd.Series([len(encode(enc, t)) for t in texts], dtype="int64")

    return df.withColumn(out, sizes(F.col(text)))
