"""Toxicity by cumulative-link ordinal regression on sparse text features.

The labels tell three kinds of texts: not toxic, toxic in good quality, toxic in poor quality. Grade 0 is not toxic. The
order of the toxic kinds is learned: each half of the training rows is scored by a model of toxic or not that was fitted
on the other half, and the kind with the larger mean gets the higher grade, so a grade up is a step further from clean
texts. Kinds that the labels do not show are left out. P(grade >= k) = sigmoid(w x - t_k) with one weight vector for all thresholds
t_1 < t_2. The features are the words of a text and their beginnings of 4 to 6 letters, as present or not; those that
stand out in toxic texts of the training rows are kept, and those that a text has share the value 1 equally, so that
a long text with many of them does not leave the middle grade.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: At most so many labelled documents are learned from, and so many features kept.
TRAINING_ROWS = 12_000
FEATURES = 1_000
LEAST_DOCS = 5
LEAST_Z = 6.0
TOXIC_FROM = 0.5
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def features(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update({f"{w[:n]}*" for w in words if len(w) > n})
    return out


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """text and kind (0 not toxic, 1 toxic in good quality, 2 toxic in poor quality) of at most `rows` labelled documents, those with the least hash of their ids; of rows
    that share an id, the one with the least text.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    kind = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    some = one.select("doc_id", kind.alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by `rows`
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("kind").alias("kind")).select("text", "kind")


class Model:
    """kinds: the kind of each grade, from grade 0 on."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, thresholds: np.ndarray, kinds: list[int]):
        self.vocabulary, self.weights, self.thresholds, self.kinds = vocabulary, weights, thresholds, kinds

    def chances(self, score: float) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest."""
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        known = self.vocabulary
        found = {known[w] for w in words if w in known}
        for n in PREFIXES:
            found.update(known[p] for w in words if len(w) > n and (p := f"{w[:n]}*") in known)
        return float(self.weights[sorted(found)].mean()) if found else 0.0


def fit_weights(rows: list[list[int]], y: np.ndarray, d: int, levels: int, steps: int = 600, rate: float = 0.1, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the cumulative-link model, by Adam on the mean log-loss."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = np.repeat([1 / max(len(r), 1) for r in rows], [len(r) for r in rows])
    idx = np.array([i for r in rows for i in r], np.int64)
    share = np.array([(y >= k).mean() for k in range(1, levels)])
    start = -np.log(np.clip(share, 1e-6, 1) / np.clip(1 - share, 1e-6, 1))
    theta = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(y)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cut = np.concatenate([[theta[d]], theta[d] + np.cumsum(gaps)])
        x = np.bincount(at, w[idx] * value, n) if len(idx) else np.zeros(n)
        up = np.concatenate([np.ones((n, 1)), sigmoid(x[:, None] - cut), np.zeros((n, 1))], axis=1)
        p = np.maximum(up[np.arange(n), y] - up[np.arange(n), y + 1], 1e-12)
        slope = up * (1 - up)
        lo, hi = slope[np.arange(n), y] / p, slope[np.arange(n), y + 1] / p
        gx = -(lo - hi) / n
        gcut = np.array([(lo[y == k].sum() - hi[y == k - 1].sum()) / n for k in range(1, levels)])
        grad = np.concatenate([np.bincount(idx, gx[at] * value, d) if len(idx) else np.zeros(d), [gcut.sum()], [gcut[j:].sum() * gaps[j - 1] for j in range(1, levels - 1)]])
        grad[:d] += ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[d + 1 :])
    return theta[:d], np.concatenate([[theta[d]], theta[d] + np.cumsum(gaps)])


def ordered_kinds(rows: list[list[int]], kinds: np.ndarray, d: int) -> list[int]:
    """The toxic kinds by their mean score in halves that the model was not fitted on."""
    half, scores = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for side in (0, 1):
        train = [rows[i] for i in np.flatnonzero(half != side)]
        w, _ = fit_weights(train, (kinds[half != side] > 0).astype(int), d, 2)
        for i in np.flatnonzero(half == side):
            scores[i] = w[rows[i]].mean() if rows[i] else 0.0
    return sorted({int(k) for k in kinds if k}, key=lambda k: (float(scores[kinds == k].mean()), k))


def fit(training: DataFrame, most_features: int = FEATURES) -> Model:
    """training: text and kind, a bounded number of rows. Feature counts are made on the workers.

    Where no feature stands out, all texts have one severity, the mean grade of the training rows.
    """
    training = training.cache()
    sizes = {r.kind: r["count"] for r in training.groupBy("kind").count().collect()}
    toxic, clean = sum(n for g, n in sizes.items() if g), sizes.get(0, 0)
    if not toxic or not clean:
        training.unpersist()
        return Model({}, np.zeros(0), np.zeros(0), sorted(sizes)[:1])

    def count(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in features(text):
                    seen.setdefault(f, [0, 0])[kind > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["f", "c", "t"])

    sums = training.select("text", "kind").mapInArrow(count, "f string, c bigint, t bigint").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    share = (F.col("c") + F.col("t") + 1) / (toxic + clean + 2)
    z = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    kept = sums.filter(F.col("t") >= LEAST_DOCS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(most_features)
    vocabulary = {r.f: i for i, r in enumerate(kept.select("f").collect())}

    def rows(batches):
        for b in batches:
            found = [sorted(vocabulary[f] for f in features(t) if f in vocabulary) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], ["x", "kind"])

    data = training.select("text", "kind").mapInArrow(rows, "x array<int>, kind int").collect()
    training.unpersist()
    data.sort(key=lambda r: (r.kind, r.x))  # the halves do not hang on the order in which rows come
    found, kinds = [r.x for r in data], np.array([r.kind for r in data])
    order = [0, *ordered_kinds(found, kinds, len(vocabulary))]
    y = np.array([order.index(k) for k in kinds])
    w, cuts = fit_weights(found, y, len(vocabulary), len(order))
    return Model(vocabulary, w, cuts, order)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic, severity (the expected grade), toxic_chance for every document.

    Null and empty texts have no features and get the severity of such texts. Rows that repeat get equal results, a
    null doc_id is kept, other columns are ignored. Without toxic and clean training rows every severity is 0.
    """

    def run(batches):
        for b in batches:
            chances = [model.chances(model.score(t.as_py())) for t in b.column(1)]
            expected = [float(c.sum()) for c in chances]
            first = [float(c[0]) if len(c) else 0.0 for c in chances]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c >= TOXIC_FROM for c in first], pa.bool_()), pa.array(expected, pa.float64()), pa.array(first, pa.float64())], ["doc_id", "toxic", "severity", "toxic_chance"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, toxic boolean, severity double, toxic_chance double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
