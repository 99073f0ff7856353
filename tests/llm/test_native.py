"""The operators without Python in their tasks, against plain Python versions."""

import re
import time
from hashlib import sha256

from pyspark.sql import functions as F

from tests.llm import corpora
from visitlens.llm import licenses, sketches

LICENSED = [
    "Released UNDER THE mit-license; under the MIT license.",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "cc by nc cc by nc CC-BY-NC 4.0",
    "SPDX-License-Identifier: GPL-3.0 and GNU Lesser General Public License v2.1",
    "see https://creativecommons.org/licenses/by-sa/4.0/ all rights reserved",
    "submit summits mitigation",
    "the apache license version 2",
    "under the mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X Corp. nor the names of its contributors may be used to endorse or promote products.",
    "ported from Python 2, PHP 3, artistic 1st prize, boost 1%",
    "Python 2.0 license, the Artistic License 2.0, boost-1.0, boost software license 1.0",
    "dual-licensed under MIT; (at your option) any later version, see the LICENSE file for details",
    "gpl license " * 30,
    " ".join(f"filler{i} licensed under the apache license, version 2.0; gpl-2.0 license mit license" for i in range(200)),
    "x" * 5000 + " mit license " + "y" * 5000,
]


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_signatures(text):
    flat = re.sub(r"[\x00-\x20]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(m.start(), m.end(), p, lab) for p, k, lab, pattern, _ in licenses.signatures() if k in flat for m in re.finditer(pattern, flat, re.A)]
    return {x[3] for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and (y[2] < x[2] or y[2] == x[2] and y[1] - y[0] > x[1] - x[0]) for y in found)}


def test_licenses_match_brute_force(spark):
    data = corpora.rows(n=20) + [(4000 + i, t, None, None, None) for i, t in enumerate(LICENSED)]
    got = {r.doc_id: r for r in licenses.scan_licenses(corpora.frame(spark, data).withColumnRenamed("lang", "words")).collect()}
    for doc, text, *_ in data:
        r = got[doc]
        base = brute_base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base, text
        labels = brute_signatures(text) | set(filter(None, base[4].split(",")))
        assert r.labels == ",".join(sorted(labels)), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    assert got[4003].labels == "gpl-3.0,lgpl-2.1" and got[4008].labels == "mit" and got[4009].labels == "bsd,bsd-3-clause" and got[4010].labels == ""
    assert licenses.scan_licenses(corpora.frame(spark, [])).count() == 0


def test_names_beside_other_characters_pass_the_gate(spark):
    want = {
        "\u201cMIT License\u201d": "mit",
        "\u00abApache License 2.0\u00bb": "apache-2.0",
        "\u00a9MIT License": "mit",
        "\u201cLicense: GPL-3.0\u201d": "gpl-3.0",
        "\u2014ISC license\u2014": "isc",
        "\u00a0zlib license": "zlib",
        "\u2022released under the BSD license": "bsd",
        "\u201call rights reserved\u201d": "proprietary",
        "see \u201chttp://mycreativecommons.org/licenses/by/4.0\u201d": "cc-by-4.0",
    }
    data = [(i, t, None, None, None) for i, t in enumerate(want)]
    got = {r.doc_id: r for r in licenses.scan_licenses(corpora.frame(spark, data)).collect()}
    for i, (text, label) in enumerate(want.items()):
        assert got[i].labels == label and brute_signatures(text) == {label} and got[i].score > 0, text


def test_detections_are_in_place_over_blocks(spark):
    text = " ".join(f"filler{i} licensed under the apache license, version 2.0 gpl license" for i in range(300))
    (r,) = licenses.scan_licenses(corpora.frame(spark, [(1, text, None, None, None)])).collect()
    spots = {(d.a, d.b) for d in r.detections}
    low = text.lower()
    assert {low[a:b] for a, b in spots} == {"licensed under the apache license, version 2.0", "gpl license"} and len(spots) == 600


def test_a_long_text_of_matches_and_odd_rows(spark):
    long = "gpl license " * 90_000
    data = [(1, long, None, None, None), (None, "mit license", None, None, None), (None, "mit license", None, None, None), (2, "mit license", None, None, None), (2, "isc license", None, None, None)]
    docs = corpora.frame(spark, data).selectExpr("*", "1 as found", "'x' as plain", "'y' as flat", "2 as words", "3 as detections")
    began = time.time()
    rows = licenses.scan_licenses(docs).select("doc_id", "labels", F.size("detections").alias("n")).collect()
    assert time.time() - began < 120
    assert sorted(((r.doc_id, r.labels, r.n) for r in rows), key=str) == sorted([(1, "gpl", 90_000), (None, "mit", 1), (None, "mit", 1), (2, "mit", 1), (2, "isc", 1)], key=str)


def test_there_are_hundreds_of_signatures():
    assert len(licenses.signatures()) > 300
    for _, keyword, _, pattern, _ in licenses.signatures():
        assert keyword == keyword.lower() and re.compile(pattern)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    data = [(d, t, *x) for d, t, *x in corpora.rows(n=40) if d not in (902,)]
    rows = {r.doc_id: r for r in sketches.fingerprints(corpora.frame(spark, data).withColumnRenamed("lang", "sketch")).collect()}
    order = sorted(data, key=lambda x: x[0])
    seen = {}
    for (doc, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", rows[doc]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            want = jaccard(shingles(text), shingles(other))
            assert abs(got - want) < (0.2 if len(shingles(text) | shingles(other)) > 128 else 1e-9), (doc, got, want)
        n = len(shingles(text))
        assert abs(r.n_shingles - n) <= 0.4 * n


def test_one_row_ties_and_no_rows(spark):
    assert sketches.fingerprints(corpora.frame(spark, [])).count() == 0
    one = sketches.fingerprints(corpora.frame(spark, [(1, "a b c d e f g h", None, None, None)])).collect()[0]
    assert one.near_next == 1.0
    ties = sketches.fingerprints(corpora.frame(spark, [(1, "a b c", None, None, None), (1, "a b c", None, None, None), (None, "x", None, None, None), (2, None, None, None, None)]))
    assert ties.count() == 4


def test_sketches_merge(spark):
    data = corpora.rows(n=30)
    df = corpora.frame(spark, data).filter("text is not null").withColumn("s", sketches.sketch(F.col("text")))
    merged = sketches.merge_all(df.withColumn("g", F.lit(1)), ["g"], "s").collect()[0].s
    plain = sorted({h for r in df.select("s").collect() for h in r.s})[: sketches.K]
    assert merged == plain
    a, b = df.orderBy("doc_id").limit(2).collect()
    both = spark.createDataFrame([(a.s, b.s)], "a array<long>, b array<long>").select(sketches.merge(F.col("a"), F.col("b"))).first()[0]
    assert both == sorted({*a.s, *b.s})[: sketches.K]
