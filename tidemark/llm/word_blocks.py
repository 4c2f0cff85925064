"""Words of many documents as numbers in one array, and blocks of words that repeat within a document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Documents are taken together until they have so many words; a longer document is taken alone.
TOGETHER = 400_000


def words_of(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a UTF-8 text: bytes.split() parts at just these six."""
    return (text or b"").split()


def together(items: Sequence, size, most: int = TOGETHER) -> Iterator[list]:
    """Stretches of items of about `most` in size."""
    some, total = [], 0
    for item in items:
        some.append(item)
        total += size(item)
        if total >= most:
            yield some
            some, total = [], 0
    if some:
        yield some


def numbered(docs: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts): a number for each word, the same for equal words of a document and for no others.

    A document's numbers lie in the range of its places; after each document there is one more number that occurs once,
    so that no block that reaches past an end repeats.
    """
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    names = np.arange(starts[-1])
    for at, words in zip(starts, docs):
        last = dict(zip(words, range(len(words))))
        names[at : at + len(words)] = np.fromiter(map(last.__getitem__, words), np.int64, len(words)) + at
    return names, starts


def in_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size): keys in order, and for each place in it the first place and the size of its equal keys."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(keys)))
    return order, np.repeat(edge, size), np.repeat(size, size)


def repeating(names: np.ndarray, at: np.ndarray, after: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, names): of the places `at`, those whose block, named in `names`, and the one named in `after` gap places on repeat together.

    The new names are those of the joint blocks; a block that does not repeat has its place as its name.
    """
    order, first, size = in_groups(names[at] * np.int64(len(names)) + after[at + gap])
    sorted_at, joint = at[order], np.arange(len(names))
    joint[sorted_at] = sorted_at[first]
    return np.sort(sorted_at[size > 1]), joint


def both(at: np.ndarray, gap: int, n: int) -> np.ndarray:
    """The places in the sorted `at` from which gap places on lies another of them."""
    known = np.zeros(n + gap, bool)
    known[at] = True
    return at[known[at + gap]]


def repeated_words(names: np.ndarray) -> np.ndarray:
    """The places whose word occurs more than once."""
    return np.flatnonzero(np.bincount(names, minlength=len(names))[names] > 1)
