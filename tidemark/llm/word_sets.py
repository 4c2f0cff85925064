"""Lines as ordered sets of word hashes, by whole-array operations on the bytes of many texts at once.

Words are runs of other bytes than \\x20 and \\x09-\\x0D; A-Z count as a-z. A word's hash takes eight of its bytes at a
time, and mixes them; words of more than LONG_WORD bytes are hashed by xxhash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import xxhash

#: Texts are joined until they have so many bytes.
CHUNK = 400_000
LONG_WORD = 64
#: A token: so many bits of rank, then of hash. Lines are numbered by the bits that are left.
RANK_BITS, HASH_BITS, LINE_BITS = 21, 30, 13
TOKEN_BITS = RANK_BITS + HASH_BITS
U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Which bits hold the first 0 to 8 bytes.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def mixed(x: np.ndarray, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A permutation of 64-bit numbers in which each bit depends on many."""
    x = x ^ (x >> U(32))
    x *= U(factor)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = (raw == 32) | ((raw - np.uint8(9)) < np.uint8(5))
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[::2], at[1::2]


def hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    text = text.translate(LOWER)
    raw = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))  # the eight bytes from each place on
    size = end - start
    out = eight[start] & FIRST[np.minimum(size, 8)]
    out += size.astype(U) * U(0x9E3779B97F4A7C15)
    out = mixed(out)
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        out[more] = mixed(out[more] ^ eight[start[more] + at] & FIRST[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        out[w] = xxhash.xxh64_intdigest(text[start[w] : end[w]])
    return out


class Lines(NamedTuple):
    """The lines of several texts: of each its text, its number there and how many words it has; the words' hashes."""

    text: np.ndarray
    number: np.ndarray
    count: np.ndarray
    word: np.ndarray


def text_lines(texts: Iterable[bytes | None]) -> Iterator[Lines]:
    """All lines of the texts, many at a time. Texts are cut at line feeds only."""
    pieces, size = [], 0
    for i, text in enumerate(texts):
        text, first, at = text or b"", 0, 0
        while len(text) - at > CHUNK and (cut := text.find(b"\n", at + CHUNK)) >= 0:
            pieces.append((i, first, text[at:cut]))
            first, at = first + pieces[-1][2].count(b"\n") + 1, cut + 1
            yield _lines(pieces)
            pieces, size = [], 0
        pieces.append((i, first, text[at:] if at else text))
        size += len(pieces[-1][2]) + 1
        if size > CHUNK:
            yield _lines(pieces)
            pieces, size = [], 0
    if pieces:
        yield _lines(pieces)


def _lines(pieces: list[tuple[int, int, bytes]]) -> Lines:
    joined = b"\n".join(p[2] for p in pieces)
    raw = np.frombuffer(joined, np.uint8)
    start, end = words(raw)
    feeds = np.flatnonzero(raw == 10)
    count = np.diff(np.concatenate(([0], np.searchsorted(start, feeds), [len(start)])))
    own = np.array([p[2].count(b"\n") + 1 for p in pieces], np.int64)
    text = np.repeat(np.array([p[0] for p in pieces], np.int64), own)
    number = np.arange(len(count)) + np.repeat(np.array([p[1] for p in pieces], np.int64) - (np.cumsum(own) - own), own)
    return Lines(text, number, count, hashes(joined, start, end))


class Sets(NamedTuple):
    """Sets of tokens: all tokens, each set's rarest first; where each set begins, and its size."""

    token: np.ndarray
    start: np.ndarray
    size: np.ndarray


def ordered_sets(count: np.ndarray, word: np.ndarray, rank: np.ndarray) -> Sets:
    """The distinct words of at most 2 ** LINE_BITS lines, by rank and then by hash. Every line has a word."""
    line = np.repeat(np.arange(len(count), dtype=U), count)
    key = line << U(TOKEN_BITS) | rank[(word & U((1 << RANK_BITS) - 1)).astype(np.int64)].astype(U) << U(HASH_BITS) | word >> U(64 - HASH_BITS)
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    size = np.add.reduceat(keep, np.cumsum(count) - count, dtype=np.int64)  # each line's words lie where they lay
    return Sets(key[keep] & U((1 << TOKEN_BITS) - 1), np.cumsum(size) - size, size)


def within(length: np.ndarray) -> np.ndarray:
    """0, 1, ... for each group of the given lengths."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
