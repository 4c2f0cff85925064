"""License scans with ordered signature rules, by DataFrame functions only.

A rule is a regular expression over a text's words joined by single spaces, with a keyword that must be among the
words before the expression is tried, as must any word that its form asks for, a priority, a label and a confidence. Detections that lie within one of a higher
priority, or within a longer or earlier one of their own priority, are suppressed. The base phrases are counted apart
and are never suppressed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: label: words of the base phrase
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_V = r"(?:v|version |ver |v )?"
_GNU = r"(?:gnu )?"
#: (label, keyword, expression for the name of the license, without the word license)
NAMES = [
    ("mit-0", "mit", r"mit (?:0|zero|no attribution)"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"(?:mit )?expat"),
    ("x11", "x11", r"(?:mit )?x11"),
    ("apache-1.0", "apache", rf"apache(?: software)?(?: license)? {_V}1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)? {_V}1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license)? {_V}2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?(?: foundation)?"),
    ("agpl-3.0", "affero", rf"{_GNU}affero general public(?: license)? {_V}3(?: 0)?"),
    ("agpl", "affero", rf"{_GNU}affero general public"),
    ("agpl-3.0", "agpl", rf"agpl ?{_V}3(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"{_GNU}lesser general public(?: license)? {_V}2 1"),
    ("lgpl-3.0", "lesser", rf"{_GNU}lesser general public(?: license)? {_V}3(?: 0)?"),
    ("lgpl", "lesser", rf"{_GNU}lesser general public"),
    ("lgpl-2.0", "library", rf"{_GNU}library general public(?: license)?(?: {_V}2(?: 0)?)?"),
    ("lgpl", "lgpl", rf"lgpl(?: ?{_V}\d(?: \d)?)?"),
    ("gpl-1.0", "general", rf"{_GNU}general public(?: license)? {_V}1(?: 0)?"),
    ("gpl-2.0", "general", rf"{_GNU}general public(?: license)? {_V}2(?: 0)?"),
    ("gpl-3.0", "general", rf"{_GNU}general public(?: license)? {_V}3(?: 0)?"),
    ("gpl", "general", rf"{_GNU}general public"),
    ("gpl-2.0", "gpl", rf"{_GNU}gpl ?{_V}2(?: 0)?"),
    ("gpl-3.0", "gpl", rf"{_GNU}gpl ?{_V}3(?: 0)?"),
    ("gpl", "gpl", rf"{_GNU}gpl"),
    ("gpl-2.0", "gplv2", rf"{_GNU}gplv2(?: 0)?"),
    ("gpl-3.0", "gplv3", rf"{_GNU}gplv3(?: 0)?"),
    ("lgpl-2.1", "lgplv2", rf"{_GNU}lgplv2 1"),
    ("lgpl-2.0", "lgplv2", rf"{_GNU}lgplv2(?: 0)?"),
    ("lgpl-3.0", "lgplv3", rf"{_GNU}lgplv3(?: 0)?"),
    ("agpl-3.0", "agplv3", rf"{_GNU}agplv3(?: 0)?"),
    ("gfdl", "documentation", rf"{_GNU}free documentation"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mozilla", rf"mozilla public(?: license)? {_V}1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public(?: license)? {_V}2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("mpl", "mpl", rf"mpl(?: ?{_V}\d \d)?"),
    ("epl-1.0", "eclipse", rf"eclipse public(?: license)? {_V}1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public(?: license)? {_V}2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl-1.0", "distribution", r"common development and distribution"),
    ("cpl-1.0", "common", r"common public"),
    ("eupl", "european", r"european union public"),
    ("artistic-2.0", "artistic", rf"artistic(?: license)? {_V}2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("bsl-1.0", "boost", r"boost software"),
    ("busl-1.1", "business", r"business source"),
    ("sspl-1.0", "server", r"server side public"),
    ("elastic-2.0", "elastic", rf"elastic(?: license)?(?: {_V}2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python", r"python(?: software foundation)?"),
    ("php", "php", r"php"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl"),
    ("ofl-1.1", "font", r"(?:sil )?open font"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d(?: \d)?)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d(?: \d)?)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: \d(?: \d)?)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: \d(?: \d)?)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: \d(?: \d)?)?"),
    ("cc-by", "cc", r"cc by(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("cc", "creative", r"creative commons"),
]
_L = r"licen[cs]e"
#: (form, expression around the name, priority (higher wins), confidence)
FORMS = [
    ("identifier", rf"spdx {_L} identifier {{name}}", 3, 1.0),
    ("grant", rf"(?:licensed|released|distributed|available|provided|published|covered|redistributed?) under (?:both )?(?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?{{name}}(?: public)?(?: {_L})?(?: version \d(?: \d)?)?", 3, 0.98),
    ("subject", rf"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{{name}} {_L}", 2, 0.9),
    ("named", rf"(?:the )?{{name}} {_L}(?: (?:version )?\d(?: \d)?)?", 1, 0.8),
]
#: names that are common words too: they need the word license behind them
COMMON = frozenset("python php postgresql elastic artistic libpng zlib x11 font freebsd server business boost common".split())
#: a second license: "under MIT and GPLv2"
JOINED = rf"under (?:both )?(?:the )?(?:terms of (?:the )?)?(?:mit|expat|apache|bsd|isc|gnu|gpl|gplv2|gplv3|lgpl|lgplv2|lgplv3|agpl|mpl|epl|artistic|zlib|boost)(?: (?!and |or )[^ ]+){{{{0,6}}}} (?:and|or) (?:the )?(?:terms of (?:the )?)?{{name}}"
PRIORITIES = (3, 2, 1)
#: (label, keyword, expression) for sentences of license texts and notices
BODIES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "contributors", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used"),
    ("gpl", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "plainly", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license"),
]
#: (label, words) of identifiers that come with versions; the keyword is the first word
VERSIONED = [
    ("gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", ("1.0", "3.0")),
    ("gfdl", "gfdl", ("1.1", "1.2", "1.3")),
]
IDENTIFIED = [
    ("apache", "apache", ("1.0", "1.1", "2.0")), ("mpl", "mpl", ("1.0", "1.1", "2.0")), ("epl", "epl", ("1.0", "2.0")), ("eupl", "eupl", ("1.0", "1.1", "1.2")), ("cddl", "cddl", ("1.0", "1.1")),
    ("cecill", "cecill", ("1.0", "1.1", "2.0", "2.1")), ("osl", "osl", ("1.0", "1.1", "2.0", "2.1", "3.0")), ("afl", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")), ("artistic", "artistic", ("1.0", "2.0")),
    ("cc0", "cc0", ("1.0",)), ("ofl", "ofl", ("1.0", "1.1")), ("bsl", "bsl", ("1.0",)), ("busl", "busl", ("1.1",)), ("sspl", "sspl", ("1.0",)), ("elastic", "elastic", ("2.0",)), ("lppl", "lppl", ("1.0", "1.1", "1.2")),
    ("upl", "upl", ("1.0",)), ("zpl", "zpl", ("2.0", "2.1")), ("odbl", "odbl", ("1.0",)), ("pddl", "pddl", ("1.0",)), ("mulanpsl", "mulanpsl", ("1.0", "2.0")), ("ecl", "ecl", ("1.0", "2.0")), ("efl", "efl", ("1.0", "2.0")),
    ("apsl", "apsl", ("1.0", "1.1", "1.2", "2.0")), ("cpal", "cpal", ("1.0",)), ("rpl", "rpl", ("1.1", "1.5")), ("qpl", "qpl", ("1.0",)), ("npl", "npl", ("1.0", "1.1")), ("ipl", "ipl", ("1.0",)),
]
#: (label, keyword, expression) of identifiers of other shapes, headers, addresses and notices
SIGNATURES = [
    ("bsd-1-clause", "bsd", r"bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause(?: simplified)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause patent"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause"),
    ("bsd-3-clause-clear", "bsd", r"bsd 3 clause clear"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause"),
    ("0bsd", "0bsd", r"0bsd"),
    ("ms-pl", "ms", r"ms pl"),
    ("ms-rl", "ms", r"ms rl"),
    ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"),
    ("lppl-1.3c", "lppl", r"lppl 1 3c"),
    ("odc-by-1.0", "odc", r"odc by 1 0"),
    ("blueoak-1.0.0", "blueoak", r"blueoak 1 0 0"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter)"),
    ("mit-0", "mit", r"mit 0"),
    ("mit", "license", r"license (?:id |name |type )?mit"),
    ("isc", "license", r"license (?:id |name |type )?isc"),
    ("zlib", "license", r"license (?:id |name |type )?zlib"),
    ("ncsa", "license", r"license (?:id |name |type )?ncsa"),
    ("x11", "license", r"license (?:id |name |type )?x11"),
    ("wtfpl", "license", r"license (?:id |name |type )?wtfpl"),
    ("unlicense", "license", r"license (?:id |name |type )?unlicense"),
    ("mit", "licensed", r"mit licensed"),
    ("apache", "licensed", r"apache licensed"),
    ("bsd", "licensed", r"bsd licensed"),
    ("gpl", "licensed", r"gpl licensed"),
    ("lgpl", "licensed", r"lgpl licensed"),
    ("agpl", "licensed", r"agpl licensed"),
    ("mpl", "licensed", r"mpl licensed"),
    ("apache-1.1", "apache", r"apache org licenses license 1 1"),
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("mit", "opensource", r"opensource org licenses? mit"),
    ("isc", "opensource", r"opensource org licenses? isc"),
    ("zlib", "opensource", r"opensource org licenses? zlib"),
    ("artistic-2.0", "opensource", r"opensource org licenses? artistic(?: license)? 2 0"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("apache-2.0", "opensource", r"opensource org licenses? apache 2 0"),
    ("gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", r"gnu org licenses gpl 3 0"),
    ("gpl", "gnu", r"gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("agpl-3.0", "gnu", r"gnu org licenses agpl 3 0"),
    ("agpl", "gnu", r"gnu org licenses agpl"),
    ("gfdl", "gnu", r"gnu org (?:licenses|copyleft) fdl"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1"),
    ("mpl", "mozilla", r"mozilla org mpl"),
    ("epl-1.0", "eclipse", r"eclipse org (?:legal|org documents) epl v10"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl 2 0"),
    ("bsl-1.0", "boost", r"boost org license 1 0"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd \d \d"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d \d"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("ofl-1.1", "ofl", r"scripts sil org ofl"),
    ("sspl-1.0", "mongodb", r"mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", r"elastic co licensing elastic license"),
    ("gpl-2.0", "either", r"general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "either", r"general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "either", r"lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "either", r"lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", "either", r"affero general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "either", r"gnu gpl(?: [^ ]+){0,10} either version 2"),
    ("gpl-3.0", "either", r"gnu gpl(?: [^ ]+){0,10} either version 3"),
    ("gpl-2.0", "published", r"general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", "published", r"general public license version 3 as published by the free software foundation"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "subject", r"subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("mit", "merchantability", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("ncsa", "illinois", r"university of illinois ncsa open source license"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("beerware", "beerware", r"beerware license"),
    ("json", "evil", r"shall be used for good not evil"),
    ("openssl", "openssl", r"openssl license"),
    ("curl", "curl", r"curl license"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("gpl-classpath", "classpath", r"(?:gpl|general public license)(?: [^ ]+){0,4} with (?:the )?classpath exception"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("commercial", "commercial", r"under a commercial license"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
]
#: parts of the identifiers of one family, for which all versions have rules
CC_PARTS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
BODY = 3, 0.95
IDENTIFIER = 2, 0.95


def signatures() -> list[tuple[str, str, str]]:
    """(label, keyword, expression) of all single signatures: those of identifiers with versions are made from their lists."""
    out = [(f"{label}-{v}{end}", word, f"{word} {v.replace('.', ' ')}{end.replace('-', ' ')}") for label, word, versions in VERSIONED for v in versions for end in ("-only", "-or-later", "")]
    out += [(f"{label}-{v}", word, f"{word} {v.replace('.', ' ')}") for label, word, versions in IDENTIFIED for v in versions]
    out += [(f"cc-{part.replace(' ', '-')}-{v}", "cc", f"cc {part} {v.replace('.', ' ')}") for part in CC_PARTS for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    return out + SIGNATURES


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(number, label, keyword, expression, priority, confidence), in order: every form of every name, signatures, then bodies."""
    out = []
    for label, keyword, name in NAMES:
        for kind, form, priority, confidence in [*FORMS, ("joined", JOINED, 2, 0.9)]:
            if kind == "named" and "(?: license)?" in name:  # the word stands within the name, before its version
                form = "(?:the )?{name}"
            elif kind == "named" and name == "mit":  # "mit" is a word of German, and "licence" one of French
                form = rf"(?:(?:the )?{{name}} license|(?:the|an|expat|under|of) {{name}} licence)(?: (?:version )?\d(?: \d)?)?"
            elif kind in ("grant", "joined") and keyword in COMMON and " public" not in name:
                form = form.replace(rf"{{name}}(?: public)?(?: {_L})?", rf"{{name}} {_L}") if kind == "grant" else f"{form} {_L}"
            out.append((len(out), label, keyword, f" {form.format(name=f'(?:{name})')}(?= )", priority, confidence))
    for label, keyword, signature in signatures():
        out.append((len(out), label, keyword, f" {signature}(?= )", *IDENTIFIER))
    return out + [(len(out) + i, label, keyword, f" {body}(?= )", *BODY) for i, (label, keyword, body) in enumerate(BODIES)]


def _rule_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({n}, '{label}', '{kw}', r'{exp}', {p}, double({c}), {_also(exp)})" for n, label, kw, exp, p, c in rules())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, label, keyword, expression, priority, confidence, also)")


def _also(expression: str) -> str:
    """Words of which a text must have one for the expression to match, as SQL; none where it can match without."""
    if ") under (?:" in expression or expression.startswith(" under "):
        return "array('under')"
    return "array('license', 'licence')" if re.search(rf" {re.escape(_L)}(?!\)\?)", expression) else "cast(array() as array<string>)"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, rule, label, confidence, start, stop for every detection that is not suppressed.

    start and stop are characters of the text's words joined by spaces. Rows with equal doc_id and text give one set of
    detections.
    """
    text = F.coalesce("text", F.lit(""))
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(_lower(text)).alias("words"))
    keywords = sorted({r[2] for r in rules()})
    found = worded.withColumn("keyword", F.explode(F.array_intersect("words", F.array(*[F.lit(k) for k in keywords]))))
    # a table of a few hundred rules, whatever the input
    rules_of = F.broadcast(_rule_table(docs.sparkSession))
    tried = found.join(rules_of, "keyword").filter((F.size("also") == 0) | F.arrays_overlap("words", "also")).drop("also").withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    hit = tried.withColumn("hits", F.regexp_extract_all("line", F.col("expression"), F.lit(0))).filter(F.size("hits") > 0)
    parts = hit.withColumn("gaps", F.split("line", F.col("expression"), -1))
    flat = parts.select("doc_id", "text_hash", "rule", "label", "priority", "confidence", F.posexplode(F.arrays_zip("hits", "gaps")).alias("at", "x"))
    flat = flat.filter(F.col("x.hits").isNotNull()).select("*", F.length("x.hits").alias("n"), F.length("x.gaps").alias("gap")).drop("x")
    flat = flat.repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "rule", "at"])
    run = W.partitionBy("doc_id", "text_hash", "rule").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = flat.withColumn("stop", F.sum(F.col("n") + F.col("gap")).over(run)).withColumn("start", F.col("stop") - F.col("n"))
    # by start, longer first: whatever contains an interval stands before it
    before = W.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("stop"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(before).alias(f"_reach{p}") for p in PRIORITIES]
    seen = placed.select("*", *reach)
    # equal intervals of a higher priority come first by the order above
    own = reduce(lambda e, p: F.when(F.col("priority") == p, F.col(f"_reach{p}")).otherwise(e), PRIORITIES, F.lit(None))
    return seen.filter(F.coalesce(own < F.col("stop"), F.lit(True))).select("doc_id", "text_hash", "rule", "label", "confidence", "start", "stop")


def _stands(phrase: tuple[str, ...]):
    """Whether the phrase begins at word i."""
    return lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get("words", i + j) == w, F.lit(False)) for j, w in enumerate(phrase)])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    A null or empty text has no words and no labels. Rows without a doc_id and rows that repeat are scanned like any
    other. Other columns are ignored; an empty table gives no rows. score is the largest confidence of the detections
    that were kept, at least 0.8 where a base phrase stands, 0 where nothing was found.
    """
    text = F.coalesce("text", F.lit(""))
    candidate = F.lower(text).contains("license")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(_words(text)).cast("bigint").alias("n_words"), F.when(candidate, _words(_lower(text))).otherwise(F.array().cast("array<string>")).alias("words"))
    at = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    for label, phrase in BASE.items():
        base = base.withColumn(f"_{label}", F.filter(at, _stands(phrase)))
    base = base.drop("words")
    places = F.concat(*[F.col(f"_{x}") for x in BASE])
    own = F.array_compact(F.array(*[F.when(F.size(f"_{x}") > 0, F.lit(x)) for x in BASE]))
    base = base.select("doc_id", "text_hash", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"), own.alias("own"))
    found = detections(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("confidence"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    both = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["text_hash"] == found["_hash"]), "left")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    score = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.8)).otherwise(F.lit(0.0)))
    labels = F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("own")).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
