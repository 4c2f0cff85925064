"""Lists of the line index: what they give does not hang on how their postings come."""

import numpy as np
import pyarrow as pa

from tidemark.llm import line_dedup, word_sets


def postings(*rows):
    """Columns key, sid, par, id of lines of ten words."""
    key, sid, par, id = np.array(rows, np.int64).T
    return np.stack((key, sid, par, np.zeros_like(key), id, np.full_like(key, 10 << line_dedup.POS_BITS)))


def pairs(pieces):
    lists = line_dedup.Lists(0.8)
    batches = [b for p in pieces for b in lists.add(p)] + list(lists.end())
    return {tuple(sorted(((r["sid"], r["par"]), (r["sid2"], r["par2"])))) for b in batches for r in b.to_pylist() if r["key"] is None}


def test_a_line_meets_those_that_come_after_a_full_bucket(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, s, 0, s) for s, k in enumerate(rng.permutation(np.repeat(np.arange(400), 3)).tolist())]
    whole = pairs([postings(*rows)])
    assert len(whole) == 1_200
    for hold in (1, 7, 100):
        monkeypatch.setattr(line_dedup, "HOLD", hold)
        assert pairs([postings(*rows[i : i + 5]) for i in range(0, len(rows), 5)]) == whole


def test_long_lists_that_begin_alone(monkeypatch):
    """One row of a list first, then too many: they all are open or paired."""
    monkeypatch.setattr(line_dedup, "HOLD", 50)
    lists = line_dedup.Lists(0.8)
    rows = [(3, s, 0, s) for s in range(3_000)]
    got = [r for i in range(0, len(rows), 40) for b in lists.add(postings(*rows[i : i + 40])) for r in b.to_pylist()]
    got += [r for b in lists.end() for r in b.to_pylist()]
    assert {r["sid"] for r in got if r["key"] is not None} == set(range(3_000))


def test_a_line_is_no_partner_of_its_own_class():
    """Two classes whose hashes end alike, one of them sent by two tasks."""
    a, b = 5, 5 + (1 << 40)
    assert pairs([postings((1, a, 0, 1), (1, b, 0, 2)), postings((1, a, 0, 1))]) == {((a, 0), (b, 0))}


def test_postings_are_sent_in_few_bytes():
    """Fewer than 37 bytes a posting, the size in which they were sent before, and none of them changed."""
    rng = np.random.default_rng(6)
    rows = rng.integers(-(1 << 63), 1 << 63, (6, 2_500))
    rows[line_dedup.KEY] = rng.integers(0, 1 << line_dedup.KEY_BITS, 2_500)
    rows[line_dedup.HALF] = 0
    rows[line_dedup.AT] = rng.integers(5, 20, 2_500) << line_dedup.POS_BITS | rng.integers(0, 4, 2_500)
    for ids, most in ((np.sort(rng.integers(0, 9_000, 2_500)), 25), (rng.integers(-(1 << 63), 1 << 63, 2_500), 33)):
        rows[line_dedup.ID] = ids
        for n in (0, 1, 2_500):
            data = line_dedup.squeezed(rows[:, :n])
            assert (line_dedup.expanded(pa.py_buffer(data), n) == rows[:, :n]).all()
        assert len(data) < most * n


def test_halves_are_sent_where_a_line_is_long():
    rng = np.random.default_rng(8)
    rows = rng.integers(-(1 << 63), 1 << 63, (6, 2_500))
    rows[line_dedup.KEY] = rng.integers(0, 1 << line_dedup.KEY_BITS, 2_500)
    rows[line_dedup.HALF, rng.random(2_500) < 0.5] = 0
    rows[line_dedup.ID] = np.sort(rng.integers(0, 9_000, 2_500))
    rows[line_dedup.AT] = rng.integers(5, 200, 2_500) << line_dedup.POS_BITS
    data = line_dedup.squeezed(rows)
    assert (line_dedup.expanded(pa.py_buffer(data), 2_500) == rows).all()
    assert data.count(rows[line_dedup.SID].tobytes()) == 1  # hashes are not worth compressing
    assert len(data) < (5 + 16 + 4 + 4) * 2_500


def test_words_by_eight_bytes():
    """Words are told apart by every byte and by their length, whatever lies around them; A-Z count as a-z."""
    long = bytes(range(97, 123)) * 5
    own = [long[:n] for n in range(1, 131)] + [long[:n] + b"\0" for n in (1, 7, 8, 9, 16, 63, 64, 65)] + [long[:n] + b"?" + long[n + 1 : 70] for n in range(70)]
    own += ["été".encode(), "Été".encode()]
    for text in (b" ".join(own), b"\t\n ".join(reversed(own)), b" ".join(own).upper()):
        start, end = word_sets.words(np.frombuffer(text, np.uint8))
        assert len(set(word_sets.hashes(text, start, end).tolist())) == len(own) == len(start)
    alone = {w: word_sets.hashes(w, np.array([0]), np.array([len(w)]))[0] for w in own}
    start, end = word_sets.words(np.frombuffer(b" ".join(own).upper(), np.uint8))
    assert word_sets.hashes(b" ".join(own).upper(), start, end).tolist() == [alone[w] for w in own]


def test_texts_are_not_sorted_to_lose_their_lines(spark):
    """Documents meet the few lists of their lines that go; only those are held."""
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}\nlast {i}") for i in range(9)], "doc_id bigint, text string")
    out = line_dedup.dedup_lines(docs, min_words=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in out.collect()) == [(i, 2, int(i > 2)) for i in range(9)]


def test_the_first_of_each_group():
    rng = np.random.default_rng(9)
    for least, most in ((-(1 << 62), 1 << 62), (-50, 50), (1 << 61, (1 << 61) + 9_000)):
        group, by = rng.integers(0, 40, 2_000), rng.integers(least, most, 2_000)
        got = line_dedup._among_first(group, by, 3)
        for g in range(40):
            assert sorted(by[got & (group == g)].tolist()) == sorted(by[group == g].tolist())[:3]
    assert len(line_dedup._among_first(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)) == 0
