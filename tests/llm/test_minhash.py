import random
import re

import pyarrow as pa

from tests.llm import corpora
from visitlens.llm.minhash import _starred, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(data):
    sets = {d: shingles(t) for d, t, *_ in data}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_brute_force(spark):
    data = corpora.rows(seed=5, n=150)
    want = brute(data)
    assert result(near_duplicates(corpora.frame(spark, data))) == want
    assert sum(not x[2] for x in want.values()) > 20


def test_a_chain_and_a_family_whose_members_differ(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    data = [(500, " ".join(words), None, None, None)]
    for i in range(40):  # each a little further from the first: a chain of links
        words = list(words)
        words[(7 * i) % 120] = f"new{i}"
        data.append((499 - i, " ".join(words), None, None, None))
    base = [f"b{i}" for i in range(100)]
    for i in range(60):  # a family near the limit: many pairs are no links
        w = list(base)
        for j in r.sample(range(100), 3):
            w[j] = f"x{i}.{j}"
        data.append((1000 + i, " ".join(w), None, None, None))
    want = brute(data)
    assert result(near_duplicates(corpora.frame(spark, data))) == want
    # clusters of many small blocks, which meet through hubs and loose members
    assert result(near_duplicates(corpora.frame(spark, data), members=7, hubs=2, loose=3)) == want


def test_entries_of_one_band_group_over_several_batches_and_ranges():
    def batch(rows):
        return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int64()), "id": pa.array([i for _, i in rows], pa.int64())})

    found = [r for b in _starred([batch([(1, 5), (2, 3)]), batch([]), batch([(2, 4), (2, 9), (3, 1)]), batch([(3, 7)])]) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in found if r["bucket"] is None} == {(3, 4), (3, 9), (1, 7)}
    assert {(r["bucket"], r["a"]) for r in found if r["bucket"] is not None} == {(1, 5), (3, 1)}
    assert list(_starred([])) == []


def test_edges(spark):
    assert near_duplicates(corpora.frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    data = [(7, text, None, None, None), (7, text, None, None, None), (None, text + " more", None, None, None), (None, "alone here", None, None, None), (None, None, None, None, None), (9, " ", None, None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(corpora.frame(spark, data).withColumnRenamed("lang", "component")).collect()), key=str)
    assert got == sorted([(7, 26, 7, True), (7, 26, 7, True), (None, 27, 7, False), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)], key=str)
