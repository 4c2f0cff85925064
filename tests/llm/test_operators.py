"""Each operator against brute force, and on odd and empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import cover_tree, html_text, language, license_scan, line_dedup, mixing, order_minhash, packing, simhash, toxicity
from tidemark.llm.common import components

DATA = "/root/testdata/sf0.001"


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def least_labels(linked, ids):
    lab = np.array(ids)
    while True:
        new = np.minimum(lab, np.where(linked, lab[None, :], 1 << 60).min(1))
        if (new == lab).all():
            return lab
        lab = new


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9] + [(5, 5), (3, 1)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(30)}


def test_order_minhash(docs):
    got = {r.doc_id: r for r in order_minhash.edit_fingerprints(docs, rows_a_range=7).collect()}
    all_texts = sorted(texts(docs).items())
    by_text = {}
    for at, (i, text) in enumerate(all_texts):
        nxt, q = all_texts[(at + 1) % len(all_texts)], len(text) // 4
        edited = text[: len(text) - q] + nxt[1][:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.25 > 0.05 > np.mean([r.near_next for r in long])


def test_order_minhash_order_matters(spark):
    words = [f"w{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    rows = spark.createDataFrame([(" ".join(words), " ".join(swapped))], "a string, b string")
    df = order_minhash.with_fingerprint(order_minhash.with_fingerprint(rows, "a", "x"), "b", "y")
    r = df.select(order_minhash.likeness("x", "x").alias("same"), order_minhash.likeness("x", "y").alias("moved")).first()
    assert r.same == 1.0 and r.moved < 0.7  # the sets of k-mers are almost equal


def test_order_minhash_odd(odd):
    got = order_minhash.edit_fingerprints(odd).collect()
    assert len(got) == 10
    assert {r.fingerprint for r in got if r.doc_id in (3, 4)} == {""}
    assert order_minhash.edit_fingerprints(odd.limit(0)).collect() == []


def test_html():
    page = "<html><head><title>t</title></head><body class='has-sidebar'><nav><a href=/>Home</a></nav><div class='ad'>Buy &lt;now&gt;</div><article><h1>Head</h1><p>One<br>two &amp; <b>three<p>Last\n word</article><section id=comments><p>I agree</p></section><form>x</form><footer>foot &am"
    assert html_text.main_text(page) == "Head\nOne two & three\nLast word"
    plain = "<body><div id=menu>a b c</div><div><h2>Title</h2><p>" + "long text " * 20 + "</p><p>Short.</p></div><p>&copy; 2020 x</p><div class=footer>f</div>"
    assert html_text.main_text(plain) == "Title\n" + ("long text " * 20).strip() + "\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>var a='<p>x</p>'") == ""


def test_html_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    import html

    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>" + "word " * 50_000, "b")], "page_id bigint, url string, html string, text string")
    assert [r.n_chars for r in html_text.extract(odd).collect()] == [0, 249_999]
    assert html_text.extract(pages.limit(0)).collect() == []


def brute_lines(rows):
    lines = [(i, j, frozenset(line.lower().split())) for i, t in sorted(rows.items()) for j, line in enumerate(t.encode().split(b"\n")) if len(line.split()) >= 5]
    inverted, gone = defaultdict(list), defaultdict(set)
    for at, (i, j, s) in enumerate(lines):
        shared = defaultdict(int)
        for w in s:
            for o in inverted[w]:
                shared[o] += 1
            inverted[w].append(at)
        if any(n / (len(s) + len(lines[o][2]) - n) >= 0.8 - 1e-12 for o, n in shared.items()):
            gone[i].add(j)
    return gone


def test_line_dedup(spark, docs):
    extra = [(10_000 + i, "\n".join(" ".join(f"w{(i * k) % 7 if k < 3 else k}" for k in range(12 + i % 3)) for _ in range(2)), "en", "s", 0) for i in range(60)]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    rows, got = texts(both), texts(line_dedup.dedup_lines(both))
    gone = brute_lines(rows)
    assert gone and got == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in rows.items()}


def test_line_dedup_long_lists(spark):
    """Lists that are longer than a batch and than LONG_LIST, with lines near the first ones and near later ones only."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w for j, w in enumerate(words) if j not in {(i * k) % 41 for k in range(3, 4 + i % 9)}), "en", "s", 0) for i in range(400)]
    both = spark.createDataFrame(rows + [(400 + i, t, *r) for i, t, *r in rows[::7]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = texts(line_dedup.dedup_lines(both))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    gone = brute_lines(texts(both))
    assert 0 < sum(map(len, gone.values())) < 457 and got == {i: "" if gone[i] else t for i, t in texts(both).items()}


def test_line_dedup_odd(odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == 10 and {c for c in odd.columns} <= set(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert by[3].text is None and by[3].n_lines == 0 and by[2].n_removed == 2 and by[2].text == "" and by[1].n_removed == 0
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_mixing(spark, docs):
    out, names = mixing.mix(docs.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = out.collect()
    p, tokens, rate = np.array([r._chances for r in rows]), np.array([r._tokens for r in rows]), np.array([r._rate for r in rows])
    share = np.array([mixing.TARGETS[n] for n in names])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.allclose((p * (tokens * rate)[:, None]).sum(0) / tokens.sum(), share / share.sum(), atol=1e-3)
    assert abs(np.array([r._copies for r in rows]).sum() - rate.sum()) < 4 * np.sqrt(len(rows))


def test_mixing_odd(odd, labels):
    got = mixing.mixed(odd, labels)
    assert got.columns == odd.columns and got.count() > 0
    assert mixing.mixed(odd.limit(0), labels).collect() == [] and mixing.mixed(odd, labels.limit(0)).count() == 10


def test_position_sets():
    sets = simhash.position_sets(4)
    assert len(sets) == 20 and all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_simhash(docs):
    rows = texts(docs)
    ids = sorted(rows)
    prints = np.array([simhash.fingerprint(rows[i].encode()) for i in ids], np.uint64)
    want = least_labels(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, ids)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in ids] == want.tolist() and [got[i].fp % (1 << 64) for i in ids] == prints.tolist()
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [i for i, c in zip(ids, want) if i == c]


def test_simhash_chains(spark):
    """Fingerprints at up to 4 bits from each other, in one ball and in chains, against all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    made = np.concatenate([base, *[base[:20] ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(12)], base[:1] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))])
    prints = np.unique(made)
    want = least_labels(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, range(len(prints)))
    signed = prints.view(np.int64).tolist()
    got = {r.fp: r.root for r in simhash.fingerprint_groups(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    groups = defaultdict(set)
    for x in signed:
        groups[got.get(x, x)].add(x)
    expect = defaultdict(set)
    for x, c in zip(signed, want):
        expect[c].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3 and by[8] == 8
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    assert simhash.one_of_each(odd).count() == 7


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.08, 0.3])
def test_cover_tree(spark, spread):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(6, 16)), 120, axis=0) + spread * rng.normal(size=(720, 16))
    unit = cover_tree.unit(x)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = sorted(cover_tree.near_duplicates(df, block=200).collect())
    assert [r.n_links for r in got] == linked.sum(1).tolist()
    assert [r.component_id for r in got] == least_labels(linked, range(720)).tolist()


def test_cover_tree_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [1.0, 0.0], 0), (9, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 9)] + [(9, 0, 9, True), (9, 2, 1, False)]
    assert cover_tree.near_duplicates(df.limit(0)).collect() == []


def test_license_base(docs, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in texts(docs).items():
        w = word.findall(text.translate(low))
        at = [(k, label) for label, p in license_scan.BASE.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1
    rows = license_scan.scan(odd).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows if r.labels == "mit"} == {1, 2}
    assert license_scan.scan(odd.limit(0)).collect() == []


def test_license_rules(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "permit license summit": "",
        "a poetic license": "",
        "MIT license and, later, the Mozilla Public License 2.0 text": "mit,mpl-2.0",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert len(license_scan.rules()) > 200


def test_toxicity(spark, docs):
    model = toxicity.fit(toxicity.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    rows = [(1, "you are a worthless idiot and a moron, pathetic"), (2, "the rain and the wind"), (3, None), (4, "")]
    got = {r.doc_id: r for r in toxicity.grade(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got[1].toxic and not got[2].toxic and got[3].severity == got[4].severity < got[1].severity
    assert (np.diff(model.thresholds) > 0).all()


def test_toxicity_odd(odd, labels):
    assert toxicity.grade(odd, toxicity.fit(toxicity.training_rows(odd, labels))).count() == 10
    assert {r.severity for r in toxicity.grade(odd, toxicity.fit(toxicity.training_rows(odd, labels.limit(0)))).collect()} == {0.0}
    assert toxicity.grade(odd.limit(0), toxicity.Model({}, np.zeros(0), np.zeros(0), [])).collect() == []


def test_tokens_equal_the_tokenizer(docs):
    ours = packing.TokenBytes()
    odd = ["a  b  c  ", "it's ÿ²3 × ÷ x", "日本 語テキスト", "x<|endoftext|>y", "\x1c a\x85b", "  ", "", "\n\n a\n", "ªº µ½¾ ", "don't we'll I'D 'S", "  a b　c", "é x"]
    for t in [*odd, *list(texts(docs).values())]:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == ours.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs, odd):
    for df in (docs, odd):
        rows = [r.asDict() for r in packing.packed(df, items_a_task=60).collect()]
        for key in {r["sequence_id"] for r in rows}:
            own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == key)
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 1024) + 1
    ours = packing.TokenBytes()
    ids = ours.tokenizer.encode("word " * 60_000, add_special_tokens=False).ids + [2]
    own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 6)
    assert [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for _, s, n, _ in own] == [t[1:] for t in own] and own[-1][2] == 1024
    assert packing.packed(odd.limit(0)).collect() == []


def test_best_fit():
    lengths = [700, 300, 24, 512, 512, 1000, 1, 23]
    bins = packing.best_fit(lengths)
    assert sorted(i for b in bins for i in b) == list(range(8)) and all(sum(lengths[i] for i in b) <= 1024 for b in bins) and len(bins) == 3


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in out]) > 0.98


def test_language_odd(odd):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5} and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(odd.limit(0)).collect() == []
    kept = language.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == 7
