import re
from collections import Counter

import duckdb

from tests.llm import corpora
from visitlens.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def more():
    r = corpora.rows(seed=8)
    base = " ".join(f"word{i}" for i in range(80))
    kinds = [base.replace(" ", " ### "), "\n".join([base] + ["same line"] * 9), base.upper(), base.replace(" ", "! "), " ".join(f"{base.split()[i]} {i}{i}" for i in range(80)), " ".join(f"{x}abcdefghijkl" for x in base.split()), base]
    return r + [(3000 + i, t, None, None, None) for i, t in enumerate(kinds)]


def test_measures_match_brute_force_and_sql(spark, tmp_path):
    data = more()
    docs = corpora.frame(spark, data)
    rows = quality.judge_quality(docs).drop("rejected_by").collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert {d: x[:6] for d, x in got.items()} == {d: brute(t) for d, t, *_ in data}
    assert [got[3000 + i][6] for i in range(7)] == [False] * 6 + [True]
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(con.execute(quality.ORACLE).fetchall()) == sorted(tuple(r) for r in rows)


def test_order_changes_no_verdict(spark):
    docs = corpora.frame(spark, more())
    kept = [sorted(r.doc_id for r in quality.judge_quality(docs, rules).filter("kept").collect()) for rules in (quality.RULES, quality.RULES[::-1])]
    assert kept[0] == kept[1] == sorted(r.doc_id for r in quality.keep_quality(docs).collect())
    assert set(quality.ordered(docs)) == set(quality.RULES)
    stats = {r.rule: r for r in quality.estimate(docs).collect()}
    assert all(r.seen > 0 and r.seconds >= 0 for r in stats.values())


def test_the_cascade_takes_what_earlier_rules_leave(spark, monkeypatch):
    base = [f"word{i}" for i in range(80)]
    shouted, marked = " ".join(base).upper(), " ".join(f"{w}! {w}x!" for w in base).upper()
    data = [(i, t, None, None, None) for i, t in enumerate([shouted] * 6 + [marked] * 10 + [" ".join(base)] * 10 + ["short"] * 50)]
    rules = (quality.Rule("exclamations", 0.25), quality.Rule("shouting", 0.5), quality.Rule("symbols", 0.125))
    docs = corpora.frame(spark, data)
    stats = {r.rule: (r.rejected, r.seen) for r in quality.estimate(docs, rules).collect()}
    assert stats == {"exclamations": (10, 26), "shouting": (16, 26), "symbols": (0, 26)}
    # all that exclaims is shouted: after the better of the two, the other one gains only what is left
    order = [r.name for r in quality.ordered(docs, rules)]
    assert order.index("symbols") == 2 if order[0] == "exclamations" else order[0] == "shouting"


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    data = [(None, long, None, None, None), (None, None, None, None, None), (1, long, None, None, None), (1, long, None, None, None), (2, "x", None, None, None)]
    docs = corpora.frame(spark, data).selectExpr("*", "1 as mask", "2 as seen", "true as kept", "'r' as rejected_by", "3 as n_words")
    rows = sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.judge_quality(docs).collect())
    assert rows == sorted([("None", 300_000, True), ("None", 0, False), ("1", 300_000, True), ("1", 300_000, True), ("2", 1, False)])
    assert quality.keep_quality(docs).columns == docs.columns and quality.keep_quality(docs).count() == 3


def test_empty_table(spark):
    assert quality.judge_quality(corpora.frame(spark, [])).count() == 0
    assert quality.keep_quality(corpora.frame(spark, [])).columns == corpora.frame(spark, []).columns
