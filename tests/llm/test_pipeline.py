from collections import defaultdict

import corpus_pipeline
from tests.llm import corpora
from tests.llm.test_dedup import brute_bytes
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_quality import more
from tests.llm.test_tokens import check_packing


def test_stages_match_brute_force(spark, tmp_path):
    docs = corpora.frame(spark, more())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    data, frames = more(), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    rows = [[tuple(r) for r in f.collect()] for f in frames[:4]]
    assert all(f.columns == docs.columns for f in frames[:4])
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(docs).collect()}
    assert sorted(rows[1]) == sorted(r for r in data if r[0] in kept)
    near = brute_near(rows[1])
    assert sorted(rows[2]) == sorted(r for r in rows[1] if near[r[0]][2])
    spans = brute_bytes(rows[2])
    assert {r[0]: len(r[1].encode()) for r in rows[3]}.keys() == spans.keys()
    for doc, text, lang, source, n in rows[3]:
        size, gone, _, _ = spans[doc]
        assert 0 <= size - gone - len(text.encode()) <= 6 * spans[doc][2] and n == len(text)
    check_packing(frames[4].collect(), {r[0]: r[1] for r in rows[3]})
    whole = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        whole[r.doc_id].append(r.length)
    assert {d: sum(x) for d, x in whole.items()} == {d: sum(r.length for r in frames[4].collect() if r.doc_id == d) for d in whole}


def test_one_row_of_each_group_stays_whatever_the_ids(spark, tmp_path):
    def prose(name, n=80):
        return " ".join(f"{name}{i}" for i in range(n))

    groups = {
        "equal rows": [(1, prose("a"), "en", "s", 1)] * 3,
        "a copy without an id": [(2, prose("b"), "en", "s", 1), (None, prose("b"), "en", "s", 1)],
        "no ids, near": [(None, prose("c"), "en", "s", 1), (None, prose("c") + " more", "en", "s", 1)],
        "no ids, equal": [(None, prose("d"), None, "s", 1)] * 2,
        "an id with two near texts": [(4, prose("e"), "en", "s", 1), (4, prose("e") + " more", "en", "s", 1)],
        "equal but for a column": [(5, prose("f"), None, "s", 1), (5, prose("f"), "s", None, 1)],
        "a near copy under another's id": [(6, prose("g"), "en", "s", 1), (7, prose("g") + " more", "en", "s", 1)],
    }
    alone = [(7, prose("h"), "en", "s", 1), (None, prose("i"), "en", "s", 1), (4, prose("j"), "en", "s", 1)]
    wordless = [(8, " ", "en", "s", 1), (8, " ", "en", "s", 1), (None, None, "en", "s", 1)]
    data = [r for rows in groups.values() for r in rows] + alone + wordless
    kept = corpus_pipeline.near_dedup(spark, corpora.frame(spark, data), str(tmp_path))
    got = [tuple(r) for r in kept.collect()]
    for name, rows in groups.items():
        assert sum(r in rows for r in got) == 1, name
    assert (2, *groups["a copy without an id"][0][1:]) in got and groups["a near copy under another's id"][0] in got
    assert all(got.count(r) == 1 for r in alone) and sorted(filter(lambda r: r in wordless, got), key=str) == sorted(wordless, key=str)
    assert len(got) == len(groups) + len(alone) + len(wordless) and kept.columns == list(corpora.frame(spark, []).columns)
    spans = {r.text for r in corpus_pipeline.repeated_spans(spark, kept, str(tmp_path)).collect()}
    assert {prose("b"), prose("h")} <= spans
    assert corpus_pipeline.near_dedup(spark, corpora.frame(spark, []), str(tmp_path)).count() == 0
