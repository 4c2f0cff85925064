"""Cases in which an operator once did less than the whole job."""

import os
import re
import zlib
from collections import Counter, defaultdict


import corpus_pipeline
from tidemark.llm import common, html_text, language, license_scan, line_dedup, mixing, packing, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def every_line(rows):
    """The texts without each line that has a word and matches an earlier line."""
    met, inverted, out = [], defaultdict(list), {}
    for i, text in sorted(rows.items()):
        left = []
        for line in text.split("\n"):
            s, shared = frozenset(line.encode().lower().split()), defaultdict(int)
            for w in s:
                for o in inverted[w]:
                    shared[o] += 1
                inverted[w].append(len(met))
            if not any(n / (len(s) + len(met[o]) - n) >= 0.8 - 1e-12 for o, n in shared.items()):
                left.append(line)
            met.append(s)
        out[i] = "\n".join(left)
    return out


def test_line_dedup_short_lines(spark, docs, tmp_path):
    planted = ["Home\nSee also\n\none two three", "see ALSO\n\nHome\nalso\none two four", "a b c d\na b c\nThree two one\n  ", "a b c d e\na b d\nd c b a\nhome home"]
    both = docs.union(spark.createDataFrame([(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(planted)], docs.schema))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    rows = texts(both)
    want = every_line(rows)
    assert [want[10_000 + i] for i in range(4)] == ["Home\nSee also\n\none two three", "\nalso\none two four", "a b c d\na b c\n  ", "a b d"]
    assert texts(line_dedup.op3_line_dedup(spark, str(tmp_path))) == want
    assert texts(corpus_pipeline.line_dedup_stage(spark, both, str(tmp_path))) == want


def test_html_surge_and_dive_around_article():
    links = "".join(f"<p><a href=/{i}>Read more of this, part {i}</a></p>" for i in range(4))
    intro, late = "An introduction stands before the marked part. " * 3, "A long closing part stands after the marked part. " * 3
    page = f"<body><p>Stub.</p>{links}<p>{intro}</p><article><h1>Head</h1><p>Text.</p></article>{links}<p>Stray.</p>{links}<main><p>M</p></main>{links}<p>{late}</p>{links}<p>End.</p>"
    assert html_text.main_text(page).split("\n") == [intro.strip(), "Head", "Text.", "M", late.strip()]


def test_license_without_the_word(spark, docs):
    cases = {
        "Released under GPL v2": "gpl-2.0",
        "distributed under the BSD 3-Clause": "bsd-3-clause",
        "available under\nApache 2.0": "apache-2.0",
        "Covered under the terms of the MIT.": "mit",
        "Built on Apache 2.0": "apache-2.0",
        "common library server in general, under the font": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(df).collect()}
    assert {i: x for i, (x, _) in got.items()} == dict(enumerate(cases.values())) and got[0][1] == got[1][1] == 0.98
    # every rule on every text, no words asked for first
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    compiled = [(n, re.compile(e)) for n, _, _, e, _, _ in license_scan.rules()]
    both = docs.select("doc_id", "text").union(df.selectExpr("doc_id + 10000", "text"))
    want = defaultdict(set)
    for i, text in texts(both).items():
        line = f" {' '.join(re.findall(license_scan.WORD, text.translate(low)))} "
        want[i] = {n for n, e in compiled if e.search(line)}
    tried = license_scan.detections(both).collect()
    assert all(r.rule in want[r.doc_id] for r in tried) and {r.doc_id for r in tried} == {i for i, x in want.items() if x}


def test_simhash_null_and_repeated_ids(spark):
    made = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(8)]
    prints = [simhash.fingerprint(t.encode()) for t in made]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 4
    rows = [(None, 0), (None, 1), (None, 2), (None, 2), (7, 3), (7, 4), (7, 4), (3, 5), (7, 5), (None, 5), (9, 6), (9, 0), (None, 7)]
    df = spark.createDataFrame([(i, made[t], n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int")
    got = simhash.one_of_each(df).collect()
    want = [(None, 1), (None, 2), (None, 7), (3, 5), (7, 3), (7, 4), (9, 0), (9, 6)]
    assert sorted((r.doc_id or 0, made.index(r.text)) for r in got) == sorted((i or 0, t) for i, t in want)
    assert all((r.doc_id, made.index(r.text)) == rows[r.n] for r in got)


def test_mixing_capitals_beyond_the_start():
    low, high = "quiet words " * 1_000, "LOUD WORDS " * 3_000
    assert "\x00capitals" in mixing.parts(low + high) and "\x00capitals" not in mixing.parts(high[:11_000] + low * 4)
    model = mixing.Domains(["good", "poor"], {"\x00capitals": 0}, mixing.np.array([[-2.0, 2.0]]), mixing.np.zeros(2))
    assert model.chances(low + high)[1] > 0.9 and model.chances(high[:11_000] + low * 4)[1] == 0.5
    for t in ("", "1 2", "aB", "ABc", "ÄÖü é", "ÄÖÜ straße", "日本 AB", "Ⅷ\U0001d400 x", "\ud800A"):
        assert mixing.mostly_capitals(t) == (sum(map(str.isupper, t)) * 2 > sum(map(str.isalpha, t)) > 0)


def test_html_unmarked_article_in_two_parts():
    links = "".join(f"<li><a href=#{i}>Part {i} of the contents</a></li>" for i in range(5))
    first, second = "Only a short part comes before the list of contents, with just two sentences. It is text all the same.", "The long part goes on. " * 60
    for a, b in ((first, second), (second, first)):
        page = f"<body><div><p>{a}</p><ul>{links}</ul><p>{b}</p></div><ul>{links}</ul><p>Stray.</p>"
        assert html_text.main_text(page).split("\n") == [a.strip(), b.strip()]


def test_pipeline(spark, monkeypatch):
    """run() stores each stage's result; each stage against brute force on what the one before it left."""
    seen = {}

    def noted(name, stage):
        def call(spark, docs, sf_dir):
            seen[name] = docs
            return stage(spark, docs, sf_dir)

        return name, call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    packed = corpus_pipeline.run(spark, DATA)
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file:"))) - before
    names = list(seen)
    assert len([f for f in left if f.startswith("stored-")]) == len(names)  # the stages' tables and no others
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for df in [*[seen[n] for n in names[1:]], packed]:
        assert df.inputFiles() and all("/stored-" in f for f in df.inputFiles())
    into = {n: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for n, df in seen.items()}
    assert sorted(into["line_dedup"]) == sorted((i, t) for i, t in into["language_id"] if t and any(map(str.isalpha, t)))
    assert dict(into["simhash_near_dedup"]) == every_line(dict(into["line_dedup"]))
    assert all(r.n_chars == len(r.text) for r in seen["simhash_near_dedup"].collect())
    prints, root = {i: simhash.fingerprint(t.encode()) for i, t in into["simhash_near_dedup"]}, {}
    for i in sorted(prints):
        if i not in root:  # all that a chain of links reaches from the least id
            todo = [i]
            while todo:
                at = todo.pop()
                root[at] = i
                todo += [j for j in prints if j not in root and j not in todo and (prints[at] ^ prints[j]).bit_count() <= 4]
    assert sorted(into["mixing"]) == sorted((i, t) for i, t in into["simhash_near_dedup"] if root[i] == i)
    out, domains = mixing.mix(seen["mixing"].select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = out.collect()
    p, tokens, rate = (mixing.np.array([getattr(r, c) for r in rows]) for c in ("_chances", "_tokens", "_rate"))
    share = mixing.np.array([mixing.TARGETS[d] for d in domains])
    assert mixing.np.allclose(tokens, [len(r.text.split()) for r in rows])
    assert mixing.np.allclose((p * (tokens * rate)[:, None]).sum(0) / tokens.sum(), share / share.sum(), atol=1e-3)
    assert all(r._copies in (int(r._rate), int(r._rate) + 1) for r in rows)
    assert Counter(into["best_fit_packing"]) == +Counter({(r.doc_id, r.text): r._copies for r in rows})
    tokenizer, want, fill = packing.TokenBytes().tokenizer, Counter(), Counter()
    for (i, text), n in Counter(into["best_fit_packing"]).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        ends = range(len(ids), 0, -1024)  # the first piece takes the rest of the division
        for start, end in ((max(0, e - 1024), e) for e in ends):
            want[i, start, end - start, zlib.crc32(mixing.np.array(ids[start:end], "<u4").tobytes())] += n
    pieces = packed.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces) == want
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_language_accepts_all_where_nothing_is_learned(spark, docs):
    rows = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert language.accepted(rows).count() == 2
    learned = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10_001, "ᚠᚢᚦ ᚨᚱᚲ ᚷᚹᚺ ᚾᛁᛃ", None), (10_002, "12 34", None)], "doc_id bigint, text string, lang string"))
    kept = {r.doc_id for r in language.accepted(learned).collect()}
    assert not kept & {10_001, 10_002} and kept == {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    only = language.accepted(learned, languages={"de"})
    assert 0 < only.count() < len(kept)


def test_language_vectors_of_many_trigrams():
    """Beyond what is held, and over several slices, a vector is the plain sum of its trigrams' vectors."""
    e = language.Encoder(64)
    text = "".join(chr(0x4E00 + (i * i) % 20_000) for i in range(language.MOST_TRIGRAMS + 5_000)) + " ab ab"
    want, units = mixing.np.zeros(64), [ord(c) for c in f" {text} "]
    for a, b, c in zip(units, units[1:], units[2:]):
        want += mixing.np.roll(e.letter(a), 2).astype(int) * mixing.np.roll(e.letter(b), 1) * e.letter(c)
    for _ in range(2):
        assert mixing.np.allclose(e.vector(text), want / mixing.np.linalg.norm(want), atol=1e-5)
    assert len(e.rows) <= language.MOST_TRIGRAMS and len(e.letters) <= language.MOST_LETTERS + 1


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i % 40}") for i in range(3_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] * 3, "doc_id bigint, quality int, toxic int")
    assert mixing.labelled(docs, labels, 10).count() == 10 and toxicity.training_rows(docs, labels, 10).count() == 10
    got = sorted(r.text for r in toxicity.training_rows(docs, labels).collect())
    assert got == sorted(min(f"text {i}", f"text {i + 20}") for i in range(20))


def test_line_dedup_index():
    """Two lines of the least similarity meet under a key: the words of a prefix, or one of enough adjacent pairs."""
    rng = mixing.np.random.default_rng(4)
    for threshold in (0.7, 0.8, 0.9):
        sizes = mixing.np.arange(3, 3_000)
        paired = sizes >= threshold * (sizes + 1) - 1e-9
        for rare in (0, 1, 2, 5, 20):
            use = paired & (rare <= line_dedup.most_missing(sizes, threshold))
            assert (line_dedup.adjacent_pairs(sizes, rare, threshold)[use] <= (sizes - rare - 1)[use]).all()
        rank = mixing.np.arange(1 << 21, dtype=mixing.np.int32)
        for _ in range(400):
            n = int(rng.integers(4, 60))
            m = int(rng.integers(n, int(n / threshold) + 1))
            shared = int(mixing.np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9))
            if shared > n or shared == n == m:
                continue
            words = rng.permutation(1 << 21)[: n + m - shared].astype(mixing.np.uint64)
            x, y = words[:n], mixing.np.concatenate((words[:shared], words[n:]))
            ranks = line_dedup.Ranks(rank, 0, int(rng.integers(0, 1 << 21)))
            keys = [line_dedup.prefix_keys(line_dedup.ordered_sets(mixing.np.array([len(s)]), s, rank), ranks, threshold)[0] for s in (x, y)]
            found = {k >> line_dedup.POS_BITS: k for k in keys[0].tolist()}
            places = [(found[k >> line_dedup.POS_BITS], k) for k in keys[1].tolist() if k >> line_dedup.POS_BITS in found]
            low = (1 << line_dedup.POS_BITS) - 1
            assert any((a & low) + (b & low) <= n + m - 2 * shared for a, b in places)


def test_license_bodies_and_repeated_rows(spark):
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd",
        "Neither the name of Foo Bar, Inc. nor the names of its contributors may be used to": "bsd-3-clause",
        "Distributed under GPLv3.": "gpl-3.0",
        "released under the LGPLv2.1": "lgpl-2.1",
        "the FreeBSD license": "bsd-2-clause",
        "they hereby state that contributors redistribute": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == dict(enumerate(cases.values()))
    text = "Apache 2.0 first. Licensed under the Apache License, Version 2.0. Then: licensed under the MIT license."
    one = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    many = spark.createDataFrame([(1, text)] * 3 + [(None, text)] * 2, "doc_id bigint, text string")
    spots = lambda df: sorted((r.rule, r.start, r.stop) for r in license_scan.detections(df).collect() if r.doc_id == 1)
    line = f" {' '.join(re.findall(license_scan.WORD, text.lower()))} "
    got = spots(many)
    assert got == spots(one) and all(re.fullmatch(license_scan.rules()[n][3].removesuffix("(?= )"), line[a:b]) for n, a, b in got)
    # suppression against brute force: what lies in one of a higher priority, or in a longer or earlier one of its own
    tried = [(n, p, m.start(), m.end()) for n, _, _, e, p, _ in license_scan.rules() for m in re.finditer(e, line)]
    order = sorted(tried, key=lambda x: (x[2], -x[3], -x[1], x[0]))
    want = [x for i, x in enumerate(order) if not any(y[1] >= x[1] and y[3] >= x[3] for y in order[:i])]
    assert got == sorted((n, a, b) for n, _, a, b in want)
    assert len(license_scan.scan(many).collect()) == 5 and {r.labels for r in license_scan.scan(many).collect()} == {r.labels for r in license_scan.scan(one).collect()}


def test_pipeline_odd_and_empty(spark, odd, labels, tmp_path):
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert rows and not {r.doc_id for r in rows} & {3, 4, 5}
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
