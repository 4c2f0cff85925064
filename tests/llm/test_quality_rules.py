"""Rule statistics against plain counting; the forest on held-out labels, on planted rows and on odd tables."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality_rules as q
from tidemark.llm.word_blocks import words_of

SPACE = " \t\n\v\f\r"


def plain(text):
    """The base columns by their definition."""
    text = text or ""
    words = [w.decode() for w in words_of(text.encode())]
    seen, twice = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            twice += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(inside)]


def test_base_columns_equal_plain_counts(docs):
    rng = random.Random(1)
    made = [" ".join(rng.choice("abc") + rng.choice(["", "\n", "#", "é ", "|"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    odd = [None, "", " \n\t\n", "\n\n", "a", "a b c", "a b c a b c", "a a a a", "x\nx\n x\nx \n\nx", "日本 語 #<>", "word " * 5000, " a b"]
    texts = [*made, *odd, *[r.text for r in docs.select("text").collect()]]
    base, more = q.measured([None if t is None else t.encode() for t in texts])
    assert base.tolist() == [plain(t) for t in texts]
    assert np.isfinite(more).all()
    assert q.measured([])[0].shape == (0, 5)


def test_paths_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    forest = q.grown(x, x.min(0), x.max(0), rng, trees=20, sample=64, depth=8)

    def walk(tree, row):
        node = 0
        while forest.column[tree, node] >= 0:
            node = forest.child[tree, node] + int(row[forest.column[tree, node]] > forest.cut[tree, node])
        return forest.length[tree, node]

    some = rng.normal(size=(50, 4)) * 2
    assert np.allclose(forest.paths(some), [np.mean([walk(t, row) for t in range(20)]) for row in some])
    far = np.full((1, 4), 9.0)
    assert forest.paths(far)[0] < forest.paths(x).min() + 1


def test_threshold_errs_least():
    rng = np.random.default_rng(4)
    for _ in range(30):
        paths, good = np.round(rng.normal(size=40), 1), rng.random(40) < 0.7
        cost = lambda t: 5 * (good & (paths < t)).sum() + (~good & (paths >= t)).sum()
        assert cost(q.threshold(paths, good)) == min(cost(t) for t in [*np.unique(paths), paths.max() + 1])


@pytest.mark.parametrize("x, good", [(np.zeros((0, 8)), np.zeros(0, bool)), (np.ones((5, 8)), np.ones(5, bool)), (np.ones((5, 8)), np.arange(5) > 0)])
def test_little_or_equal_training_rows(x, good):
    forest = q.fit(x, good, trees=5)
    assert forest.paths(np.ones((3, 8))).shape == (3,)
    assert (forest.paths(np.ones((3, 8))) >= forest.least).all() or len(x)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest = q.learned(q.training_rows(docs, labels.filter("doc_id % 2 = 0")))
    held = q.judged(docs, forest).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    good, poor = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert len(good) > 100 and len(poor) > 5
    assert np.mean(good) >= 0.98 and np.mean(poor) <= 0.1


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = q.op11_quality_rules(spark, d)
    rows = got.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == [*want, failed]
        assert not (failed and r.kept)
    assert dict(got.dtypes) == {"doc_id": "bigint", "path_length": "double", "kept": "boolean", "base_failed": "boolean"} | {c: "bigint" for c in q.BASE}
    again = {r.doc_id: r.kept for r in q.op11_quality_rules(spark, d).collect()}
    assert again == {r.doc_id: r.kept for r in rows}


def test_odd_and_empty_tables(spark, odd, labels):
    forest = q.learned(q.training_rows(odd, labels))
    got = q.judged(odd, forest).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.base_failed)
    assert {r.doc_id: (r.n_words, r.word_chars) for r in got}[3] == (0, 0)
    none = q.learned(q.training_rows(odd.limit(0), labels.limit(0)))
    assert q.judged(odd.limit(0), none).collect() == []
    assert {r.kept for r in q.judged(odd, none).filter("not base_failed").collect()} <= {True}
