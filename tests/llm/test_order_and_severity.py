"""Order MinHash against a version of its own; ids with very many rows; severities on held-out rows."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import order_minhash as om
from tidemark.llm import toxicity


def chained(*values):
    """Spark's xxhash64 of several values: each is hashed with the hash before it as seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h & (2**64 - 1))
    return h - 2**64 if h >= 2**63 else h


def plain(text, k=3, tuple_size=2, bins=32):
    """range -> tuple hash, by the definition: number the occurrences, take the least of each range, restore text order."""
    tokens = re.findall(r"[⺀-鿿가-힣]|[^\s⺀-鿿가-힣]{1,16}", text or "")
    seen, items = defaultdict(int), []
    for i in range(max(1, len(tokens) - k + 1) if tokens else 0):
        gram = (chained(*tokens[i : i + k]) % 2**64) >> 31
        number = xxhash.xxh64_intdigest(struct.pack("<i", seen[gram]), chained(gram) % 2**64)  # an int has four bytes
        items.append((number >> 31, i))
        seen[gram] += 1
    out = {}
    for b in range(bins):
        least = sorted(x for x in items if x[0] >> 28 == b)[:tuple_size]
        if least:
            h = 42
            for item, _ in sorted(least, key=lambda x: x[1]):
                h = xxhash.xxh64_intdigest(struct.pack("<q", item), h)
            out[b] = h & 0xFFFFFFFF
    return out


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(3)
    texts = [None, "", "one", "one two", "a a a a a a", "日本語 テキスト한국어", "x" * 100, " ".join(rng.choice("abcde") for _ in range(400))]
    texts += [" ".join(rng.choice(["red", "blue", "green", "tall", "small"]) + str(rng.randrange(9)) for _ in range(rng.randrange(300))) for _ in range(40)]
    df = om.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "fp")
    for r in df.collect():
        assert {v >> 32: v & 0xFFFFFFFF for v in r.fp} == plain(r.text), r.text


def test_likeness_equals_the_definition(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(30):
        a = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(1, 80))]
        b = a[: len(a) // 2] + [rng.choice("abc") for _ in range(rng.randrange(20))]
        pairs.append((" ".join(a), " ".join(b)))
    df = om.with_fingerprint(om.with_fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "x"), "b", "y")
    for r in df.select("a", "b", om.likeness("x", "y").alias("near")).collect():
        x, y = plain(r.a), plain(r.b)
        assert abs(r.near - sum(x.get(i) == y.get(i) for i in x) / len(x.keys() | y.keys())) < 1e-12


def test_ids_with_very_many_rows_are_parted(spark):
    """A quarter of all rows without an id and a quarter with one id: no range has much more than its share."""
    rows = [(None if i % 4 == 0 else 7 if i % 4 == 1 else i, f"text {i} " + "ab" * (i % 5)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    base = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64("text").alias("h"))
    sizes = base.groupBy(om._ranges(base, F.col("o"), F.col("h"), 20, 65_536).alias("r")).count().collect()
    assert max(r["count"] for r in sizes) <= 80 and len(sizes) > 150

    def spark_hash(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - 2**64 if h >= 2**63 else h

    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], spark_hash(r[1]), r[1]))
    want = Counter()
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(text) // 4
        want[i, len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in om.edit_fingerprints(df, rows_a_range=20).collect())
    assert got == want


def test_repeated_rows_follow_each_other(spark):
    rows = [(1, "same text here")] * 50 + [(2, "other words are in this")] + [(1, "a second text")]
    got = om.edit_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_a_range=3).collect()
    assert len(got) == 52 and sum(r.near_next == 1.0 for r in got) == 49


def loss(theta, rows, y, d):
    """Mean log-loss of the cumulative-link model, by its definition."""
    w, cuts, total = theta[:d], theta[d:], 0.0
    for r, k in zip(rows, y):
        x = w[r].mean() if r else 0.0
        up = [1.0, *(1 / (1 + np.exp(-(x - c))) for c in cuts), 0.0]
        total -= np.log(up[k] - up[k + 1])
    return total / len(rows) + 0.5e-6 * (w**2).sum()


def test_weights_are_at_the_least_loss():
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist()) for _ in range(300)]
    y = np.array([int(np.clip(round((sum(1 - 2 * (i % 2) for i in r)) + rng.normal()), 0, 2)) for r in rows])
    w, cuts = toxicity.fit_weights(rows, y, 4, 3, steps=3000, rate=0.05)
    best = np.concatenate([w, cuts])
    # an independent solver: steps along each coordinate, halved where they do not help
    other, step = np.array([0.0] * 4 + [-1.0, 1.0]), 1.0
    while step > 1e-5:
        before = loss(other, rows, y, 4)
        for i in range(6):
            for sign in (1, -1):
                moved = other.copy()
                moved[i] += sign * step
                if moved[4] < moved[5] and loss(moved, rows, y, 4) < loss(other, rows, y, 4):
                    other = moved
        step = step if loss(other, rows, y, 4) < before else step / 2
    assert abs(loss(best, rows, y, 4) - loss(other, rows, y, 4)) < 1e-4 and cuts[0] < cuts[1]


@pytest.mark.parametrize("side", [0, 1])
def test_severity_rises_with_the_grade_on_held_out_rows(spark, side):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels.filter(f"doc_id % 2 = {side}")))
    assert model.kinds[0] == 0 and sorted(model.kinds) == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    held = toxicity.training_rows(docs.filter(f"doc_id % 2 = {1 - side}"), labels).withColumn("doc_id", F.monotonically_increasing_id()).cache()
    found = toxicity.grade(held, model).join(held.select("doc_id", "kind"), "doc_id").groupBy("kind").agg(F.avg("severity").alias("s")).collect()
    by = {r.kind: r.s for r in found}
    assert by[model.kinds[0]] < 0.1 < 0.5 < by[model.kinds[1]] < by[model.kinds[2]], by


def test_order_of_the_kinds_does_not_hang_on_their_numbers():
    rng = np.random.default_rng(1)
    rows, kinds = [], []
    for i in range(400):
        kind = [0, 0, 1, 2][i % 4]
        strong = {0: 0, 1: 4, 2: 1}[kind]  # kind 1 has more of what tells toxic texts
        rows.append(sorted(rng.choice(8, strong, replace=False).tolist() + (8 + rng.choice(8, 4 - strong, replace=False)).tolist()))
        kinds.append(kind)
    assert toxicity.ordered_kinds(rows, np.array(kinds), 16) == [2, 1]
    assert toxicity.ordered_kinds(rows, np.array([{0: 0, 1: 2, 2: 1}[k] for k in kinds]), 16) == [1, 2]
