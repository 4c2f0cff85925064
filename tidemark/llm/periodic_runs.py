"""Periodic runs of words by internal pattern matching.

The blocks are dyadic: of 2^k words, starting at the multiples of 2^(k-1). A suffix array over the places whose block of
four words repeats is refined by doubling, so that the places of equal blocks of every length are an interval of it. A
wavelet tree over it answers the successor query: the next place of a block after its own. The places of a block that
start within its own length form an arithmetic progression, whose difference is the candidate period.

Why no run is missed: a run of period q and at least max(6, 4 q) words holds, for the least length 2^k >= max(q, 4), a
block that lies in it together with its copy q words on. Both lie in a stretch of period q, and the block is no shorter
than q, so an earlier copy would give the run a smaller period. Neighbouring blocks with the same difference are one
stretch, which goes on for less than half a block on both sides.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.word_blocks import both, in_groups, numbered, repeated_words, repeating, together, words_of

LEAST_WORDS, LEAST_TIMES = 6, 4
#: the shortest blocks
SHORTEST = 4


def suffix_intervals(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, blocks): the suffix array of the places whose block of SHORTEST words repeats, and the repeating blocks.

    A row of blocks: a place, the length of the block there, and the interval of the suffix array that has its places.
    """
    n = len(names)
    at, joint = repeating(names, both(repeated_words(names), 1, n), names, 1)
    at, joint = repeating(joint, both(at, 2, n), joint, 2)
    order, first, size = in_groups(joint[at])
    places, rank, length, blocks = at[order], np.arange(n, 2 * n), SHORTEST, []  # places that are left out rank apart
    live = np.arange(len(places))
    rank[places] = first
    while live.size:
        here = places[live]
        on_grid = here % (length // 2) == 0
        blocks.append(np.stack([here, np.full(len(here), length), first, first + size], 1)[on_grid])
        order, edge, size = in_groups(rank[here] * np.int64(2 * n) + rank[here + length])
        places[live], first = here[order], live[edge]
        rank[places[live]] = first
        kept = size > 1
        live, first, size, length = live[kept], first[kept], size[kept], 2 * length
    return places, np.concatenate(blocks) if blocks else np.zeros((0, 4), np.int64)


class WaveletTree:
    """Whole numbers below 2^bits, parted by one bit a level; a level keeps how many zeros lie before each place."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        self.bits = int(values.max()).bit_length() if values.size else 0
        for bit in reversed(range(self.bits)):
            zero = (values >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)]), int(zero.sum())))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each query the least value above x in the places [lo, hi), or -1."""
        below, a, b, x = np.zeros(len(lo), np.int64), lo, hi, x + 1
        for bit, zeros, n in self.levels:  # how many values lie below x + 1
            za, zb, one = zeros[a], zeros[b], (x >> bit) & 1 == 1
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, n + a - za, za), np.where(one, n + b - zb, zb)
        below = np.where(x >> self.bits > 0, hi - lo, below)
        none = below >= hi - lo
        rank, a, b, out = np.where(none, 0, below), lo, hi, np.zeros(len(lo), np.int64)
        for bit, zeros, n in self.levels:  # the value of that rank
            za, zb = zeros[a], zeros[b]
            one = rank >= zb - za
            rank = np.where(one, rank - (zb - za), rank)
            a, b = np.where(one, n + a - za, za), np.where(one, n + b - zb, zb)
            out |= one.astype(np.int64) << bit
        return np.where(none, -1, out)


def stretches(names: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run, starts counted through all documents."""
    places, blocks = suffix_intervals(names)
    if not len(blocks):
        return set()
    known = np.sort(places)
    tree = WaveletTree(np.searchsorted(known, places))
    at, length, lo, hi = blocks.T
    after = tree.successor(lo, hi, np.searchsorted(known, at))
    period = np.where(after >= 0, known[after] - at, 0)
    near = (period > np.where(length > SHORTEST, length // 2, 0)) & (period <= length)
    at, length, period = at[near], length[near], period[near]
    order = np.lexsort((at, period, length))
    at, length, period = at[order], length[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (length[1:] != length[:-1]) | (at[1:] > at[:-1] + length[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    found = set()
    for a, b, step, q in zip(at[first].tolist(), (at[last] + length[last]).tolist(), length[first].tolist(), period[first].tolist()):
        # names[i] == names[i + q] for a <= i < b; the stretch is widened until that fails
        while a > 0:
            lo = max(0, a - step)
            off = np.flatnonzero(names[lo:a] != names[lo + q : a + q])
            a = lo + int(off[-1]) + 1 if off.size else lo
            if off.size:
                break
        while True:
            off = np.flatnonzero(names[b : b + step] != names[b + q : b + step + q]) if b + step + q <= len(names) else np.flatnonzero(names[b : len(names) - q] != names[b + q :])
            b += int(off[0]) if off.size else step
            if off.size:
                break
        if b - a + q >= max(LEAST_WORDS, LEAST_TIMES * q):
            found.add((a, b - a + q, q))
    return found


def runs_of(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each document the (start, length, period) of its runs, by start and period."""
    names, starts = numbered(docs)
    of = defaultdict(list)
    for start, length, period in sorted(stretches(names), key=lambda r: (r[0], r[2])):
        at = int(np.searchsorted(starts, start, "right")) - 1
        of[at].append((start - int(starts[at]), length, period))
    return [of.get(i, []) for i in range(len(docs))]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run has after its first period, one space between two."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_runs(docs: DataFrame, words: Callable[[int | None, bytes | None], list[bytes]] = lambda _, text: words_of(text)) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed (a text) for each row of docs.

    words(doc_id, text) gives a document's words, bytes of UTF-8; by default those of the whole text. A null or empty
    text has no word, no run and an empty collapsed text. Rows that repeat get equal results, a null doc_id is kept,
    other columns are ignored, an empty table gives no rows. Work and memory grow with the words of a stretch of
    documents, or with the longest document.
    """

    def run(batches):
        for b in batches:
            rows = ((i, words(i, t)) for i, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1).cast(pa.binary()))))
            for some in together(rows, lambda row: len(row[1]) + 1):
                lists = [w for _, w in some]
                found = runs_of(lists)
                texts = pa.array([collapsed(w, r) for w, r in zip(lists, found)], pa.binary()).cast(pa.string())
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in of] for of in found], pa.list_(RUN))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], b.schema.field(0).type), pa.array(map(len, lists), pa.int64()), runs, texts], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted_tail(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """The words of a text; in one of ten documents, told by their ids, a stretch is repeated up to the end."""
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * ((n - a) // p + 1))[:n]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(table(spark, sf_dir, "documents"), with_planted_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("r"), F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("r.less")
    return rows.select("doc_id", "n_runs", (-F.col("r.back")).alias("start"), F.col("r.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("r.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
