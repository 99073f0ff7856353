"""License scan by ordered signature rules, in DataFrame expressions only.

Two readings of a text are scanned. The base looks for phrases of whole words (consecutive, whatever
stands between them). The signature rules are several hundred regular expressions in order of priority:
NOTICES, written one by one, know sentences of the licenses themselves; the others are written as families of names with their
versions and the ways a license is named: an identifier line, a grant ("licensed under ..."), a reference ("... license"), a link. They run only where the plain words of the text (letters and
digits of ASCII; quotes, signs and letters of other scripts end a word) hold their family's keyword and the cue of their kind, and at all only where there is any keyword. Where detections overlap, one that lies in
another of a higher priority, or of the same priority and longer, is suppressed.

A text is scanned in blocks of about BLOCK characters that end at a space. A rule also sees the next OVERLAP characters, which no
pattern exceeds, so a match belongs to the block where it begins, and what reaches over a block's end is handed to the next one.
Within a block positions are running sums, and one sweep over the detections in order of their places finds what
others contain, so the work grows with the length of a text, however many matches it holds.

score is the best confidence among what is left: identifier 1.0, notice 0.95, grant 0.9, base phrase or link 0.8, reference 0.6;
without a label it is 0.

Defined results: a null text is empty, has no words and no label. Equal rows give equal rows. Columns beyond
doc_id and text are ignored. No row needs another, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: keyword for the prefilter, label stem, pattern of the name, versions. A version v gives the label stem-v.
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?", ["1.0", "1.1", "2.0"]),
    ("agpl", "agpl", r"(?:gnu )?agpl", ["1.0", "3.0"]),
    ("affero", "agpl", r"(?:gnu )?affero general public", ["1.0", "3.0"]),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ["2.0", "2.1", "3.0"]),
    ("lesser", "lgpl", r"(?:gnu )?lesser general public", ["2.1", "3.0"]),
    ("gpl", "gpl", r"(?:gnu )?gpl", ["1.0", "2.0", "3.0"]),
    ("general public", "gpl", r"(?:gnu )?general public", ["1.0", "2.0", "3.0"]),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", ["1.1", "1.2", "1.3"]),
    ("free documentation", "gfdl", r"(?:gnu )?free documentation", ["1.1", "1.2", "1.3"]),
    ("mozilla", "mpl", r"mozilla public", ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", r"mpl", ["1.0", "1.1", "2.0"]),
    ("eclipse", "epl", r"eclipse public", ["1.0", "2.0"]),
    ("epl", "epl", r"epl", ["1.0", "2.0"]),
    ("cddl", "cddl", r"cddl", ["1.0", "1.1"]),
    ("common development", "cddl", r"common development and distribution", ["1.0", "1.1"]),
    ("eupl", "eupl", r"eupl", ["1.0", "1.1", "1.2"]),
    ("european union", "eupl", r"european union public", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic", r"artistic", ["1.0", "2.0"]),
    ("academic free", "afl", r"academic free", ["1.1", "2.0", "2.1", "3.0"]),
    ("open software", "osl", r"open software", ["1.0", "2.0", "2.1", "3.0"]),
    ("boost", "bsl", r"boost(?: software)?", ["1.0"]),
    ("openssl", "openssl", r"openssl", []),
    ("mit", "mit", r"(?:the )?mit", []),
    ("isc", "isc", r"isc", []),
    ("bsd", "bsd", r"(?:new |simplified |modified )?bsd", []),
    ("2-clause", "bsd-2-clause", r"bsd[- ]2[- ]clause", []),
    ("3-clause", "bsd-3-clause", r"bsd[- ]3[- ]clause", []),
    ("4-clause", "bsd-4-clause", r"bsd[- ]4[- ]clause", []),
    ("zlib", "zlib", r"zlib", []),
    ("unlicense", "unlicense", r"(?:the )?unlicense", []),
    ("wtfpl", "wtfpl", r"wtfpl", ["1.0", "2.0"]),
    ("zope", "zpl", r"zope public", ["1.1", "2.0", "2.1"]),
    ("php", "php", r"php", ["3.0", "3.01"]),
    ("python", "psf", r"python(?: software foundation)?", ["2.0"]),
    ("postgresql", "postgresql", r"postgresql", []),
    ("ofl", "ofl", r"(?:sil )?ofl", ["1.0", "1.1"]),
    ("open font", "ofl", r"(?:sil )?open font", ["1.0", "1.1"]),
    ("odbl", "odbl", r"odbl", ["1.0"]),
    ("open database", "odbl", r"open database", ["1.0"]),
    ("microsoft", "ms-pl", r"microsoft public", []),
    ("ms-pl", "ms-pl", r"ms-pl", []),
    ("beer", "beerware", r"beer-?ware", []),
]
COMMONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
LONG_NAMES = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Kinds of signature: priority (lower wins), confidence.
KINDS = {"identifier": (1, 1.0), "notice": (15, 0.95), "grant": (2, 0.9), "link": (3, 0.8), "reference": (4, 0.6)}
BASE_CONFIDENCE = 0.8
BLOCK, OVERLAP = 2048, 320
#: Sentences of licenses: keyword for the prefilter, label, pattern. All are of the kind notice.
NOTICES = [
    ("hereby granted", "mit", r"\bpermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\b"),
    ("merge, publish", "mit", r"\bto use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies of the software\b"),
    ("portions of the software", "mit", r"\bthis permission notice shall be included in all copies or substantial portions of the software\b"),
    ("with or without fee", "isc", r"\bpermission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\b"),
    ("with or without fee", "hpnd", r"\bpermission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and|with or) without fee is hereby granted\b"),
    ("isc disclaims", "isc", r"\bisc disclaims all warranties with regard to this software\b"),
    ("source and binary forms", "bsd", r"\bredistribution and use in source and binary forms, with or without modification, are permitted\b"),
    ("retain the above copyright", "bsd", r"\bredistributions of source code must retain the above copyright notice\b"),
    ("reproduce the above copyright", "bsd", r"\bredistributions in binary form must reproduce the above copyright notice\b"),
    ("endorse or promote", "bsd-3-clause", r"\bneither the names? of .{1,80} nor the names of (?:its|the|any) contributors may be used to endorse or promote products\b"),
    ("advertising materials", "bsd-4-clause", r"\ball advertising materials mentioning features or use of this software must display\b"),
    ("compliance with the license", "apache-2.0", r"\byou may not use this file except in compliance with the license\b"),
    ("grant of patent license", "apache-2.0", r"\bgrant of patent license\. subject to the terms and conditions of this license\b"),
    ("redistribute it", "gpl", r"\byou can redistribute it and/or modify it under the terms of the gnu general public license\b"),
    ("redistribute it", "lgpl", r"\byou can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license\b"),
    ("redistribute it", "agpl", r"\byou can redistribute it and/or modify it under the terms of the gnu affero general public license\b"),
    ("version 2 of the license", "gpl-2.0-or-later", r"\bgeneral public license as published by the free software foundation[;,] either version 2 of the license,? or (?:\(at your option\) )?any later version\b"),
    ("version 3 of the license", "gpl-3.0-or-later", r"\bgeneral public license as published by the free software foundation[;,] either version 3 of the license,? or (?:\(at your option\) )?any later version\b"),
    ("version 2 of the license", "gpl-2.0-only", r"\bgeneral public license version 2 as published by the free software foundation\b(?! or)"),
    ("received a copy", "gpl", r"\byou should have received a copy of the gnu general public license\b"),
    ("received a copy", "lgpl", r"\byou should have received a copy of the gnu (?:lesser|library) general public license\b"),
    ("received a copy", "agpl", r"\byou should have received a copy of the gnu affero general public license\b"),
    ("classpath exception", "gpl-classpath-exception", r"\bclasspath exception\b"),
    ("linking this library", "gpl-classpath-exception", r"\blinking this library statically or dynamically with other modules\b"),
    ("runtime library exception", "gpl-runtime-exception", r"\bgcc runtime library exception\b"),
    ("terms of the mozilla", "mpl-2.0", r"\bthis source code form is subject to the terms of the mozilla public license, v\. 2\.0\b"),
    ("terms of the eclipse", "epl", r"\bthis program and the accompanying materials are made available under the terms of the eclipse public license\b"),
    ("accept no responsibility", "zlib", r"\bthe origin of this software must not be misrepresented\b"),
    ("misrepresented", "zlib", r"\bthe origin of this software must not be misrepresented; you must not claim that you wrote the original software\b"),
    ("altered source versions", "zlib", r"\baltered source versions must be plainly marked as such\b"),
    ("free and unencumbered", "unlicense", r"\bthis is free and unencumbered software released into the public domain\b"),
    ("do what the", "wtfpl", r"\byou just do what the f[a-z*]+ you want to\b"),
    ("boost software", "bsl-1.0", r"\bdistributed under the boost software license, version 1\.0\b"),
    ("machine-executable object", "bsl-1.0", r"\bsolely in the form of machine-executable object code generated by a source language processor\b"),
    ("buy me a beer", "beerware", r"\byou can buy me a beer in return\b"),
    ("to the extent possible", "cc0-1.0", r"\bto the extent possible under law, .{1,80} has waived all copyright and related or neighboring rights\b"),
    ("no copyright", "cc0-1.0", r"\bno copyright\b.{0,40}\bdedicated the work to the public domain\b"),
    ("reserved font name", "ofl-1.1", r"\bwith reserved font names?\b"),
    ("font software", "ofl-1.1", r"\bthis font software is licensed under the sil open font license\b"),
    ("invariant sections", "gfdl", r"\bwith no invariant sections, (?:with )?no front-cover texts\b"),
    ("without express or implied", "hpnd", r"\bit is provided [\"']?as is[\"']? without express or implied warranty\b"),
    ("without warranty of any", "warranty-disclaimer", r"\bthe software is provided [\"']?as is[\"']?, without warranty of any kind\b"),
    ("implied warranties", "warranty-disclaimer", r"\bany express or implied warranties, including, but not limited to\b"),
    ("without any warranty", "warranty-disclaimer", r"\bbut without any warranty; without even the implied warranty of merchantability\b"),
    ("without warranties or", "warranty-disclaimer", r"\bwithout warranties or conditions of any kind, either express or implied\b"),
    ("licensed under", "dual-license", r"\bdual[- ]licensed under\b"),
    ("any later version", "or-later", r"\bor \(at your option\) any later version\b"),
    ("license file", "license-file", r"\blicense file for (?:details|more information|the full text)\b"),
    ("license file", "license-file", r"\bin the (?:root|top[- ]level) licen[sc]e file\b"),
    ("license file in the root", "license-file", r"\bfound in the licen[sc]e file in the root directory\b"),
    ("not for commercial", "non-commercial", r"\bnot (?:to be used )?for commercial use\b"),
    ("commercial", "non-commercial", r"\bfor non-?commercial (?:use|purposes) only\b"),
    ("personal use only", "non-commercial", r"\bfor personal(?:,? non-?commercial)? use only\b"),
    ("confidential and proprietary", "proprietary", r"\bconfidential and proprietary\b"),
    ("prior written permission", "proprietary", r"\bmay not be (?:reproduced|copied|distributed)[a-z ,]{0,60} without (?:the )?(?:express |prior |written )+permission\b"),
    ("unauthorized copying", "proprietary", r"\bunauthori[sz]ed copying of this (?:file|software), via any medium is strictly prohibited\b"),
    ("end user license", "eula", r"\bend[- ]user licen[sc]e agreement\b"),
    ("government purpose", "government", r"\bgovernment purpose rights\b"),
    ("crown copyright", "ogl", r"\bcrown copyright\b"),
    ("open government", "ogl", r"\bopen government licen[sc]e\b"),
]


#: Names that are common words or products of other kinds too: a version alone makes no license of them.
COMMON_NAMES = ("artistic", "boost", "php", "python", "apache", "academic free", "open software", "open font", "open database", "eclipse public", "zope public")


def _forms(name: str, version: str | None) -> list[tuple[str, str]]:
    named = r"(?=[a-z ]{0,30},?(?: licen[sc]e|-[0-9]))" if name.startswith(COMMON_NAMES) else ""
    v = "" if version is None else r",?(?: license,?)?[ -]*(?:version |v\.? ?)?" + version.replace(".", r"\.").removesuffix(r"\.0") + (r"(?:\.0)?" if version.endswith(".0") else "") + r"(?![.]?[0-9])"
    return [
        ("identifier", rf"\bspdx-license-identifier: *{name}{v}\b"),
        ("identifier", rf"\blicense: *{name}{v}\b"),
        ("grant", rf"\b(?:licensed|released|distributed|available|provided|published)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?{name}{v}(?: licen[sc]e)?\b"),
        ("reference", rf"\b{name}{v} licen[sc]e\b" if version is None else rf"\b{name}{named}{v}\b"),
    ]


def signatures() -> list[tuple[int, str, str, str, float]]:
    """All rules as (priority, keyword, label, pattern, confidence), in order. Patterns meet text in lower case with single spaces."""
    rules = []
    for keyword, stem, name, versions in FAMILIES:
        for version in [*versions, None]:
            label = stem if version is None else f"{stem}-{version}"
            for kind, pattern in _forms(name, version):
                priority, confidence = KINDS[kind]
                rules.append((10 * priority + (version is None), keyword, label, pattern, confidence))
    for keyword, label, pattern in NOTICES:
        rules.append((KINDS["notice"][0], keyword, label, pattern, KINDS["notice"][1]))
    for kind in COMMONS:
        named = "[- ]".join(LONG_NAMES[x].replace("noncommercial", "non-?commercial").replace("sharealike", "share-?alike").replace("noderivatives", "no-?deriv(?:ative)?s?(?:works)?") for x in kind.split("-"))
        for version in COMMONS_VERSIONS:
            v = version.replace(".", r"\.")
            label = f"cc-{kind}-{version}"
            short = kind.replace("-", "[- ]")
            rules.append((30, "creativecommons.org", label, rf"creativecommons\.org/licenses/{kind}/{v}", KINDS["link"][1]))
            rules.append((20, "cc", label, rf"\bcc[- ]{short}[- ]{v}\b", KINDS["grant"][1]))
            rules.append((20, "creative commons", label, rf"\bcreative commons {named},? {v}(?: [a-z]+)?(?: licen[sc]e)?", KINDS["grant"][1]))
        rules.append((41, "cc", f"cc-{kind}", rf"\bcc[- ]{kind.replace('-', '[- ]')}\b", KINDS["reference"][1]))
    for keyword, label, pattern in [("cc0", "cc0-1.0", r"\bcc0(?:[- ]1\.0)?\b"), ("publicdomain/zero", "cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0"), ("public domain", "public-domain", r"\b(?:in|into|to) the public domain\b"), ("all rights reserved", "proprietary", r"\ball rights reserved\b"), ("opensource.org", "osi-link", r"opensource\.org/licen[sc]es?/[a-z0-9.-]{1,60}")]:
        rules.append((30, keyword, label, pattern, KINDS["link"][1]))
    return sorted(rules)


# ---- expressions ----------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_only(text: Column) -> Column:
    """The words in lower case, one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), NOT_WORD, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def _places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in the words, and the numbers of its first and last start (else null)."""
    n = len(phrase.split())
    has = F.contains(words, F.lit(f" {phrase} "))
    count = F.when(has, F.regexp_count(words, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
    first = F.when(has, _spaces(F.substring_index(words, f" {phrase} ", 1)))
    # what follows the last place begins after its space, and ends with the last space of all
    last = F.when(has, _spaces(words) - 1 - n - _spaces(F.substring_index(words, f" {phrase} ", -1)))
    return count.cast("long"), first.cast("long"), last.cast("long")


def plain_words(words: Column) -> Column:
    """What words_only gives, with a space for each run of other characters too: none of them is part of a name."""
    return F.when(F.length(words) == F.octet_length(words), words).otherwise(F.regexp_replace(words, "[^a-z0-9]+", " "))


def in_words(keyword: str, pattern: str) -> str:
    """A keyword as it stands in plain_words; at the start of a word if the pattern asks for one."""
    return (" " if pattern.startswith(r"\b") else "") + re.sub("[^a-z0-9]+", " ", keyword)


def cue(pattern: str) -> str:
    """What the plain words of any text hold that the pattern matches, by the kind of signature."""
    if "license-identifier" in pattern or pattern.startswith(r"\blicense:"):
        return " license"
    if " under (?:the )?" in pattern:
        return " under "
    return " licen" if pattern.endswith(r" licen[sc]e\b") else " "


_FOUND = "array<struct<a:int,b:int,priority:int,label:string,confidence:double>>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, wherever it stands in there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _detections(flat: Column, words: Column) -> Column:
    """For each block of a text its signature matches as structs (a, b, priority, label, confidence), in order of a; b is exclusive."""
    gated: dict[tuple[str, str], list] = {}
    for rule in signatures():
        gated.setdefault((in_words(rule[1], rule[3]), cue(rule[3])), []).append(rule)
    # rules are data in one constant: an expression for each would make a plan of thousands of nodes
    rows = [{"keyword": k, "cue": c, "rules": [{"priority": p, "label": lab, "pattern": pat, "confidence": x} for p, _, lab, pat, x in own]} for (k, c), own in gated.items()]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,cue:string,rules:array<struct<priority:int,label:string,pattern:string,confidence:double>>>>")
    active = F.flatten(F.transform(F.filter(table, lambda k: F.contains(words, k["keyword"]) & F.contains(words, k["cue"])), lambda k: k["rules"]))
    active = F.filter(active, lambda r: F.regexp_like(flat, r["pattern"]))
    begun = F.struct(F.lit(0).alias("at"), _none("array<struct<text:string,start:int>>").alias("out"))
    cut = F.regexp_extract_all(flat, F.lit(rf"(?s).{{1,{BLOCK}}}(?: |$)|.{{1,{BLOCK}}}"), F.lit(0))
    blocks = F.aggregate(cut, begun, lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.array_append(s["out"], F.struct(x.alias("text"), s["at"].alias("start"))).alias("out")))["out"]

    def places(seen: Column, match: Column, pattern: Column) -> Column:
        gaps = F.slice(F.split(seen, pattern, F.lit(-1)), F.lit(1), F.size(match))
        sizes = F.zip_with(gaps, match, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
        start = F.struct(F.lit(0).alias("at"), _none("array<struct<a:int,b:int>>").alias("out"))
        return F.aggregate(sizes, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(s["out"], F.struct((s["at"] + x["gap"]).alias("a"), (s["at"] + x["gap"] + x["own"]).alias("b"))).alias("out")))["out"]

    def matches(seen: Column, x: Column, r: Column) -> Column:
        found = _let(F.regexp_extract_all(seen, r["pattern"], F.lit(0)), lambda m: places(seen, m, r["pattern"]))
        own = F.filter(found, lambda f: f["a"] < F.length(x["text"]))
        return F.transform(own, lambda f: F.struct((f["a"] + x["start"]).alias("a"), (f["b"] + x["start"]).alias("b"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    def block(seen: Column, rules: Column, x: Column) -> Column:
        found = F.flatten(F.transform(F.filter(rules, lambda r: F.regexp_like(seen, r["pattern"])), lambda r: matches(seen, x, r)))
        by_place = F.array_sort(found, lambda p, q: F.when(p["a"] != q["a"], p["a"] - q["a"]).when(p["b"] != q["b"], q["b"] - p["b"]).otherwise(p["priority"] - q["priority"]))
        return F.struct((x["start"] + F.length(x["text"])).alias("end"), by_place.alias("found"))

    def all_blocks(rules: Column) -> Column:
        def each(parts: Column) -> Column:
            return F.transform(parts, lambda x, i: _let(F.concat(x["text"], F.substring(F.coalesce(F.get(parts, i + 1)["text"], F.lit("")), 1, OVERLAP)), lambda seen: block(seen, rules, x)))

        return F.when(F.size(rules) > 0, _let(blocks, each)).otherwise(_none(f"array<struct<end:int,found:{_FOUND}>>"))

    return _let(active, all_blocks)


def _standing(blocks: Column) -> Column:
    """Detections that do not lie in one of a higher priority, or in a longer one of the same.

    The sweep carries, per priority, how far the detections so far reach and where the first that reaches so far begins.
    """
    levels = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(0).alias("to"), F.lit(0).alias("since")) for p in sorted({r[0] for r in signatures()})])

    def step(s: Column, x: Column) -> Column:
        covered = F.exists(s["reach"], lambda r: ((r["p"] < x["priority"]) & (r["to"] >= x["b"])) | ((r["p"] == x["priority"]) & ((r["to"] > x["b"]) | ((r["to"] == x["b"]) & (r["since"] < x["a"])))))
        further = F.transform(s["reach"], lambda r: F.when((r["p"] == x["priority"]) & (r["to"] < x["b"]), F.struct(r["p"].alias("p"), x["b"].alias("to"), x["a"].alias("since"))).otherwise(r))
        return F.struct(further.alias("reach"), F.when(covered, s["out"]).otherwise(F.array_append(s["out"], x)).alias("out"))

    def over(b: Column) -> Column:
        """What the block before reaches over its end, as its own sweep left it."""
        beyond = F.filter(b["found"], lambda x: x["b"] > b["end"])
        return F.when(F.size(beyond) > 0, F.aggregate(beyond, F.struct(levels.alias("reach"), _none(_FOUND).alias("out")), step)["reach"]).otherwise(levels)

    return _let(blocks, lambda all_: F.flatten(F.transform(all_, lambda b, i: F.when(F.size(b["found"]) > 0, F.aggregate(b["found"], F.struct(F.when(i > 0, over(F.get(all_, i - 1))).otherwise(levels).alias("reach"), _none(_FOUND).alias("out")), step)["out"]).otherwise(_none(_FOUND)))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.withColumn("words", words_only(F.col("text"))).withColumn("plain", plain_words(F.col("words")))
    places = {p: _places(F.col("words"), p) for p in PHRASES}
    rules = signatures()
    free = {in_words(r[1], r[3]) for r in rules if cue(r[3]) == " "}
    cued = {in_words(r[1], r[3]) for r in rules} - free  # of no use without a cue, and some are common words
    holds = lambda keywords: reduce(or_, [F.contains("plain", F.lit(k)) for k in sorted(keywords)])
    gate = (holds({" licen", " under "}) & holds(cued)) | holds(free)
    flat = F.regexp_replace(F.translate(F.col("text"), UPPER, LOWER), r"[\x00-\x20]+", " ")
    none = _none(_FOUND)
    rows = rows.select(
        "doc_id",
        (_spaces(F.col("words")) - 1).cast("long").alias("n_words"),
        sum((c for c, _, _ in places.values()), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[a for _, a, _ in places.values()]).alias("first_word"),
        F.greatest(*[b for _, _, b in places.values()]).alias("last_word"),
        F.array_compact(F.array(*[F.when(places[p][0] > 0, F.lit(lab)) for p, lab in PHRASES.items()])).alias("base"),
        F.when(gate, flat).alias("flat"),
        "plain",
    )
    rows = rows.withColumn("detections", F.when(F.col("flat").isNotNull(), _standing(_detections(F.col("flat"), F.col("plain")))).otherwise(none))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")
