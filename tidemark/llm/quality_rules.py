"""Quality rules: an isolation forest on rule statistics of documents.

Each tree parts a random sample of labelled good rows by random cuts. The cuts are drawn from the box that all labelled
rows span, so where a tree has no good row the path to a leaf is short: statistics that good documents do not have get
short paths. The threshold on the mean path is the one that errs least on the labelled rows that no tree was grown from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.word_blocks import both, numbered, repeated_words, repeating, together, words_of

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 20_000
TREES, SAMPLE, DEPTH = 200, 256, 10
#: so many poor rows that are kept weigh as one good row that is rejected
GOOD_WEIGHT = 5
LEAST_WORDS, MOST_REPEATED = 50, 0.5
SEED = 11

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: what the forest sees: shares of words, of lines and of characters
STATISTICS = ["word_length", "symbols", "dup_lines", "repeat_words", "capitals", "marks", "bare_words", "letters"]
_CLASSES = np.zeros((256, 6))
for _i, _set in enumerate((b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)))):
    _CLASSES[list(_set), _i] = 1
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()], 4] = 1
_CLASSES[128:192, 5] = 1  # the bytes of a character after its first


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each document how many words lie in a window of three that occurs twice or more in it."""
    names, starts = numbered(docs)
    at, pairs = repeating(names, both(repeated_words(names), 1, len(names)), names, 1)
    at, _ = repeating(pairs, both(at, 1, len(names)), pairs, 1)  # two pairs that overlap in one word
    inside = np.zeros(len(names), np.int64)
    for step in range(3):
        inside[at + step] = 1
    return np.add.reduceat(inside, starts[:-1])


def measured(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(base, statistics) of UTF-8 texts, a row a text: the columns BASE and STATISTICS."""
    words = [words_of(t) for t in texts]
    base = np.zeros((len(texts), len(BASE)), np.int64)
    more = np.zeros((len(texts), len(STATISTICS)))
    if not texts:
        return base, more
    base[:, 0] = [len(w) for w in words]
    base[:, 4] = repeat_words(words)
    for i, (text, own) in enumerate(zip(texts, words)):
        if not own:
            continue
        size = len(text)
        spaces, symbols, upper, lower, marks, rest = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
        lines = [line for line in text.split(b"\n") if line.strip()]
        chars, repeated = size - spaces - rest, len(lines) - len(set(lines))
        base[i, 1:4] = chars, symbols, repeated
        bare = sum(len(w) == 1 and not w.isalnum() for w in own)
        n = len(own)
        more[i] = chars / n, symbols / n, repeated / len(lines), base[i, 4] / n, upper / max(upper + lower, 1), marks / n, bare / n, (upper + lower) / chars
    return base, more


@dataclass
class Forest:
    """Trees as arrays of nodes, a row a tree: a node's column (-1: a leaf), its cut, and its first child; a leaf's path length."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    least: float = 0.0  # mean paths below this are anomalous

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row of x."""
        x = np.asarray(x, float)
        total = np.zeros(len(x))
        for column, cut, child, length in zip(self.column, self.cut, self.child, self.length):
            at = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while live.size:
                node = at[live]
                inner = column[node] >= 0
                live, node = live[inner], node[inner]
                at[live] = child[node] + (x[live, column[node]] > cut[node])
            total += length[at]
        return total / max(len(self.column), 1)


def expected_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n keys, which a leaf of n rows stands for."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grown(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, trees: int, sample: int, depth: int) -> Forest:
    """Trees over random samples of rows, with random cuts of the box from low to high."""
    most, largest = 2 ** (depth + 1), 1
    column, cut, child, length = np.full((trees, most), -1, np.int8), np.zeros((trees, most)), np.zeros((trees, most), np.int32), np.zeros((trees, most))
    for t in range(trees):
        some = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
        todo, used = [(0, some, low, high, 0)], 1
        while todo:
            node, own, lo, hi, d = todo.pop()
            open_columns = np.flatnonzero(hi > lo)
            if len(own) < 2 or d == depth or not open_columns.size:
                length[t, node] = d + expected_path(len(own))
                continue
            c = rng.choice(open_columns)
            at = rng.uniform(lo[c], hi[c])
            column[t, node], cut[t, node], child[t, node] = c, at, used
            right = own[:, c] > at
            below, above = hi.copy(), lo.copy()
            below[c] = above[c] = at
            todo += [(used, own[~right], lo, below, d + 1), (used + 1, own[right], above, hi, d + 1)]
            used += 2
        largest = max(largest, used)
    return Forest(*(a[:, :largest].copy() for a in (column, cut, child, length)))


def threshold(paths: np.ndarray, good: np.ndarray, weight: float = GOOD_WEIGHT) -> float:
    """The path length below which the rows with the least weighted error are poor; of several the middle ones' mean."""
    order = np.argsort(paths, kind="stable")
    known, of = paths[order], good[order]
    cost = weight * np.concatenate([[0], np.cumsum(of)]) + np.concatenate([np.cumsum((~of)[::-1])[::-1], [0]])
    apart = np.concatenate([[True], known[1:] > known[:-1], [True]])  # no cut between equal paths
    best = np.flatnonzero(apart & (cost == cost[apart].min()))
    at = best[len(best) // 2]
    around = known[max(at - 1, 0) : at + 1]
    return float(known[-1] + 1 if at == len(known) else known[0] if at == 0 else around.mean())


def fit(x: np.ndarray, good: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """A forest grown from every other good row; the threshold is set on the other good rows and the poor ones.

    Without two good rows and a poor one nothing is anomalous.
    """
    rows = x[good]
    if len(rows) < 2 or good.all():
        return Forest(*[np.zeros((0, 1), int)] * 4, least=-1.0)
    forest = grown(rows[::2], x.min(0), x.max(0), np.random.default_rng(seed), trees, sample, depth)
    held = np.concatenate([rows[1::2], x[~good]])
    forest.least = threshold(forest.paths(held), np.arange(len(held)) < len(rows[1::2]))
    return forest


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < LEAST_WORDS) | (base[:, 4] > MOST_REPEATED * base[:, 0])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text and good of at most `rows` labelled documents, those with the least hash of their ids.

    Of labels that share an id the least quality counts, of texts that share one the least text.
    """
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by `rows`
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("good").alias("good"))


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


def learned(training: DataFrame, **how) -> Forest:
    """A forest from rows of training_rows. The statistics are made on the workers; the driver gets eight numbers a row."""

    def measure(batches):
        for b in batches:
            for some in together(list(zip(b.column(0).to_pylist(), _texts(b.column(1)), b.column(2).to_pylist())), lambda r: len(r[1]) // 6):
                base, more = measured([t for _, t, _ in some])
                kept = np.flatnonzero(~base_failed(base))
                yield pa.RecordBatch.from_arrays([pa.array([some[i][0] for i in kept], b.schema.field(0).type), pa.array(more[kept].tolist(), pa.list_(pa.float64())), pa.array([some[i][2] for i in kept], pa.bool_())], ["doc_id", "x", "good"])

    kind = training.schema["doc_id"].dataType.simpleString()
    found = training.select("doc_id", "text", "good").mapInArrow(measure, f"doc_id {kind}, x array<double>, good boolean").collect()
    found.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in found]).reshape(-1, len(STATISTICS)), np.array([r.good for r in found], bool), **how)


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the columns BASE and STATISTICS, path_length, base_failed and kept for each row of docs.

    Null and empty texts have no words and fail. Rows that repeat get equal results, a null doc_id is kept, other columns
    are ignored, an empty table gives no rows. Where the labels show no good or no poor documents, the base rules decide.
    """

    def run(batches):
        for b in batches:
            for some in together(list(zip(b.column(0).to_pylist(), _texts(b.column(1)))), lambda r: len(r[1] or b"") // 6 + 1):
                base, more = measured([t for _, t in some])
                failed, paths = base_failed(base), forest.paths(more)
                arrays = [pa.array(a) for a in (*base.T, *more.T, paths, failed, ~failed & (paths >= forest.least))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], b.schema.field(0).type), *arrays], names)

    names = ["doc_id", *BASE, *STATISTICS, "path_length", "base_failed", "kept"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [f"doc_id {kind}", *[f"{c} bigint" for c in BASE], *[f"{c} double" for c in [*STATISTICS, "path_length"]], "base_failed boolean", "kept boolean"]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(types))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned(training_rows(docs, table(spark, sf_dir, "labels")))).select("doc_id", *BASE, "base_failed", "kept", "path_length")
