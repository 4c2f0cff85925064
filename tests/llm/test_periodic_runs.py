"""Runs of words against a search over all periods, on small alphabets, planted repeats and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs as pr
from tidemark.llm.word_blocks import together, words_of


def brute(words):
    """(start, length, period) of every run: all periods, all maximal stretches."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                run = words[i : i + length]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(rng.randrange(70))]
    for _ in range(rng.randrange(3) if words else 0):
        at, period = rng.randrange(len(words)), rng.randrange(1, 12)
        words[at : at + rng.randrange(20)] = (words[at : at + period] * rng.randrange(2, 8))[: rng.randrange(1, 60)]
    return words


def test_runs_of_many_documents_together():
    rng, found = random.Random(3), 0
    for _ in range(25):
        docs = [planted(rng) for _ in range(40)]
        want = [brute(d) for d in docs]
        assert pr.runs_of(docs) == want
        found += sum(map(len, want))
    assert found > 500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4))
def test_runs_of_any_words(docs):
    assert pr.runs_of(docs) == [brute(d) for d in docs]


def test_long_repeats_and_a_block_at_each_end():
    words = [b"%d" % i for i in range(700)] * 5 + [b"x"] * 9
    assert pr.runs_of([words, [b"y"] * 6, [b"z"] * 5]) == [[(0, 3500, 700), (3500, 9, 1)], [(0, 6, 1)], []]


def test_successor_of_the_wavelet_tree():
    rng = np.random.default_rng(0)
    values = rng.permutation(300)
    tree = pr.WaveletTree(values)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(0, 40, 500))
    x = rng.integers(-1, 300, 500)
    want = [min((v for v in values[a:b] if v > y), default=-1) for a, b, y in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_together_takes_all_in_order():
    assert list(together([5, 1, 9, 2, 2], lambda x: x, 6)) == [[5, 1], [9], [2, 2]]


def expected(doc_id, text):
    words = words_of((text or "").encode())
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if len(set(words)) > 1 else [(0, len(words), 1)] if len(words) > 5 else []
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest, hashlib.sha256(text).hexdigest())


def as_table(spark, rows, path):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, b" ".join(planted(rng)).decode(), "en", "s", 0) for i in range(150)] + [(150, None, None, None, None), (151, "", "en", "s", 0), (None, "a b " * 9, "en", "s", 0), (7, "a\t\x0bb\n" * 400, "en", "s", 0), (8, "é x é x " * 6, "fr", "s", 0), (8, "é x é x " * 6, "fr", "s", 0), (9, "same " * 30_000, "en", "s", 0)]
    as_table(spark, rows, tmp_path)
    got = pr.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[6])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert all(t == "bigint" for c, t in got.dtypes if not c.endswith("sha256"))


def test_all_documents_of_the_smallest_table(spark, docs):
    rows = [r for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 800]
    got = {r.doc_id: r for r in pr.with_runs(docs, pr.with_planted_tail).collect()}
    assert len(got) == docs.count()
    for r in rows:
        words = pr.with_planted_tail(r.doc_id, (r.text or "").encode())
        assert [tuple(x) for x in got[r.doc_id].runs] == brute(words)


def test_odd_and_empty_tables(spark, odd):
    got = pr.with_runs(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[6].runs[0].asDict() == {"start": 0, "length": 60_000, "period": 1} and by[6].collapsed == "word"
    assert by[3].n_words == 0 and by[3].runs == [] and by[3].collapsed == ""
    assert pr.with_runs(odd.limit(0)).collect() == []


@pytest.mark.parametrize("words", [[], [b"a"], [b"a"] * 5])
def test_too_few_words(words):
    assert pr.runs_of([words]) == [[]]
    assert pr.collapsed(words, []) == b" ".join(words)
