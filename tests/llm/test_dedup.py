import random
import re
from collections import defaultdict
from hashlib import sha256

from tests.llm import corpora
from visitlens.llm import repeats
from visitlens.llm.substring_dedup import dedup_substrings
from visitlens.llm.suffix_dedup import dedup_suffixes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_words(data, window=20):
    first = {}
    for doc, text, *_ in sorted(data, key=lambda x: x[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc, i))
    out = {}
    for doc, text, *_ in data:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(data, n=200):
    count = defaultdict(int)
    texts = {doc: (text or "").encode() for doc, text, *_ in data}
    for t in texts.values():
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] += 1
    out = {}
    for doc, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[doc] = (len(t), sum(gone), spans, sha256(kept).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(spark):
    data = corpora.rows()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(corpora.frame(spark, data)).collect()}
    want = brute_words(data)
    assert got == want
    assert sum(x[1] for x in want.values()) > 100


def test_suffix_dedup_matches_brute_force(spark):
    data = corpora.rows(seed=2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_suffixes(corpora.frame(spark, data)).collect()}
    want = brute_bytes(data)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_empty_tables_and_repeated_rows(spark):
    empty = corpora.frame(spark, []) 
    assert dedup_substrings(empty).count() == 0
    assert dedup_suffixes(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    twice = corpora.frame(spark, [(1, text, None, None, None)] * 2 + [(None, text, None, None, None)]).withColumnRenamed("lang", "chunk")
    assert sorted(r.n_removed for r in dedup_substrings(twice).collect()) == [0, 60, 60]
    assert [r.n_removed for r in dedup_suffixes(twice).collect()] == [len(text)] * 3


def test_rows_that_share_an_id_but_not_the_text_compete_by_place(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 64)  # each row in a chunk of its own
    words = [f"w{i}" for i in range(60)]
    data = [(1, " ".join(words), None, None, None), (1, " ".join(words[:40]) + " x y z", None, None, None), (1, " ".join(words[5:45]), None, None, None), (None, " ".join(words), None, None, None)]
    rows = dedup_substrings(corpora.frame(spark, data)).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in rows) == [(False, 40, 40), (False, 43, 40), (False, 60, 60), (True, 60, 0)]
    rows = dedup_substrings(corpora.frame(spark, data[:3])).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(40, 0), (43, 35), (60, 40)]


def test_long_texts(spark):
    r = random.Random(3)
    passage = "".join(r.choices("abcdefgh ", k=2000))
    long = "".join(r.choices("abcdefghijklmnop ", k=3_000_000))
    data = [(1, long + passage, None, None, None), (2, passage, None, None, None)]
    got = {x.doc_id: x for x in dedup_suffixes(corpora.frame(spark, data)).collect()}
    assert got[2].n_removed == 2000 and 2000 <= got[1].n_removed <= 2010 and got[1].n_bytes == 3_002_000
    got = {x.doc_id: x for x in dedup_substrings(corpora.frame(spark, data)).collect()}
    assert got[2].n_removed > 0 and got[1].n_removed == 0
