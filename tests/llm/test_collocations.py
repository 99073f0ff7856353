"""Collocations against a brute-force count."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.corpora import ODD, SCHEMA
from visitlens.llm import collocations
from visitlens.llm.collocations import best, mine_collocations, score_phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, min_count, top=2000, share=100):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 6):
                counts.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    inside = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= share * found[lang, p[i : i + m]]:
                    inside.add((lang, p[i : i + m]))
    by_lang = {}
    for (lang, p), a in found.items():
        if (lang, p) in inside:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, rows in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def mined(spark, data, **how):
    rows = mine_collocations(spark.createDataFrame(data, SCHEMA).repartition(3), bits=1 << 16, **how).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows), rows


def corpus(seed=3, n=120):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdéβ", k=r.randint(1, 3))) for _ in range(25)]
    names = [" ".join(r.choices(words, k=k)) for k in (2, 3, 4, 5, 5, 7)]
    out = []
    for i in range(n):
        parts = [r.choice(names) if r.random() < 0.3 else r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.choice([2, 30, 90]))]
        text = "".join(p + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\r", "\x0b"]) for p in parts)
        out.append((i, text, r.choice(["en", "en", "de", None, "und"]), "s", len(text)))
    return [*out, *out[:5], *ODD]


@pytest.mark.parametrize(("seed", "how"), [(1, {"min_count": 4}), (2, {"min_count": 9, "top": 25}), (3, {"min_count": 6, "share": 60})])
def test_equals_a_brute_force_count(spark, seed, how):
    data = corpus(seed)
    got, rows = mined(spark, data, **how)
    assert got == brute(data, **how) and len(got) > 40
    texts = {}
    for d in data:
        texts.setdefault(d[0], []).append(d[1] or "")
    for r in rows[:50]:
        assert any(" ".join(re.split(r"[ \t.,;:!?\x0a-\x0d]+", t.translate(UPPER).strip(" \t.,;:!?\n\r\x0b\x0c"))[r.example_word :]).startswith(r.phrase) for t in texts[r.example_doc])


@pytest.mark.parametrize("width", [6, 14])
def test_fingerprints_that_collide_do_no_harm(spark, width):
    data = corpus(4, 60)
    counts = collocations.count_phrases(spark.createDataFrame(data, SCHEMA).repartition(3), 4, bits=1 << 16, width=width)
    got = best(score_phrases(counts)).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(data, 4) and len(got) > 40


def counted(spark, monkeypatch, data, parts):
    """Rows that each scan with pointers hands on, and the result."""
    made, scan = {}, collocations._scan

    def spy(docs, work, schema):
        found = scan(docs, work, schema)
        if schema is collocations._POINTERS:
            found = collocations.written(found)
            made[len(made)] = found.count()
        return found

    monkeypatch.setattr(collocations, "_scan", spy)
    rows = mine_collocations(spark.createDataFrame(data, SCHEMA).repartition(parts), bits=1 << 20).collect()
    return made, sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def test_longer_phrases_are_sought_in_frequent_triples_alone(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]  # every pair is frequent, no triple is
    data = [(i, " ".join(r.choices(words, k=100)), "en", "s", 0) for i in range(180)]
    made, got = counted(spark, monkeypatch, data, 3)
    assert got == brute(data, 100) and len(got) > 100
    assert sum(made.values()) < 8_000  # pairs and triples; with all lengths at once some 45,000


def test_a_frequent_phrase_costs_few_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 64)
    data = [(i, "one two three four five six " * 4, "en", "s", 0) for i in range(256)]
    made, got = counted(spark, monkeypatch, data, 64)
    assert got == brute(data, 100) and got
    assert sum(made.values()) <= 24 * collocations.WAVES * spark.sparkContext.defaultParallelism


def test_a_task_holds_and_hands_on_bounded_batches():
    every = SimpleNamespace(value=np.full(1, 2**64 - 1, np.uint64))
    per, docs = 20_000, 50

    def batches():
        for i in range(docs):
            yield pa.record_batch({"doc_id": [i], "lang": ["en"], "text": [" ".join(map(str, range(i * per, i * per + per)))]})

    def peak(work):
        rows = total = most = 0
        tracemalloc.start()
        try:
            for batch in work(batches()):
                rows, total, most = rows + batch.num_rows, total + sum(batch.column("f").to_pylist()), max(most, batch.num_rows)
                del batch
            return rows, total, most, tracemalloc.get_traced_memory()[1] >> 20
        finally:
            tracemalloc.stop()

    grams = collocations._count_grams(every, 2, range(2, 4), 64)
    for work, n in ((collocations._count_words, docs * per), (collocations._count_pairs(every, 64), docs * (per - 1)), (grams, docs * (2 * per - 3))):
        rows, total, most, mb = peak(work)
        assert rows == total == n and most <= 1 << 16 and mb < 130, (rows, total, most, mb)


def test_entries_merge_as_they_fold_at_once():
    r = np.random.Generator(np.random.PCG64(1))
    parts = [(r.integers(0, 300, 200, np.uint64), r.integers(0, 2**32, 200, np.uint32), r.integers(0, 2**32, 200, np.uint32)) for _ in range(6)]
    held = collocations._folded(*parts[0])
    for part in parts[1:]:
        collocations._merge(held, collocations._folded(*part))
    whole = collocations._folded(*[np.concatenate(x) for x in zip(*parts, strict=True)])
    assert all(np.array_equal(a, b) for a, b in zip(held, whole, strict=True))
    assert whole[1].sum() == 1200 and len(whole[0]) > 250


def test_texts_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 1 << 16, raising=False)
    sizes, scan, name = [], collocations._scan, "spark.sql.execution.arrow.maxBytesPerBatch"

    def spy(docs, work, schema):
        if {"text", "lang"} <= set(docs.columns):
            sizes.extend(x.n for x in docs.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect())
        return scan(docs, work, schema)

    monkeypatch.setattr(collocations, "_scan", spy)
    before = spark.conf.get(name)
    data = [(i, "one two three " * 600, "en", "s", 0) for i in range(120)]
    got = mine_collocations(spark.createDataFrame(data, SCHEMA).repartition(1), bits=1 << 16).collect()
    assert got and max(sizes) <= 1 << 17 and sum(sizes) > 5 * 8400 * 120
    assert spark.conf.get(name) == before


def test_large_counts_stay_exact(spark):
    big = 4 * 10**11
    rows = [("en", b"a b", big - 1, 2, (1, 0))]
    phrases = spark.createDataFrame(rows, "lang string, phrase binary, f long, n_words int, example struct<doc_id: long, word: long>")
    words = spark.createDataFrame([("en", b"a", big), ("en", b"b", big + 7), ("en", b"c", big)], "lang string, phrase binary, f long")
    totals = spark.createDataFrame([("en", 3 * big + 7)], "lang string, n long")
    (row,) = collocations.score_phrases(collocations.Counts(words, phrases, totals)).collect()
    assert row.score == 1000 * (big - 1) * (3 * big + 7) // (big * (big + 7))


def test_edges(spark):
    assert mined(spark, [], min_count=1)[0] == []
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "...", "en", "s", 3), (1, "x", "en", "s", 1)]
    assert mined(spark, odd, min_count=1)[0] == []
    long = [(1, "one two " * 60_000 + "z" * 200_000, "en", "s", 0)] * 2
    assert mined(spark, long, min_count=100)[0] == brute(long, 100)
    clash = spark.createDataFrame([(i, "a b", "en", 1, 2, 3, 4) for i in range(3)], "doc_id long, text string, lang string, phrase int, f int, code int, rank int")
    assert [(r.phrase, r.a, r.score) for r in mine_collocations(clash, min_count=3).collect()] == [("a b", 3, 2000)]
