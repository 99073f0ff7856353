"""Quality rules as a short-circuit cascade.

Each rule's cost (CPU seconds a document) and which documents it rejects are estimated on a sample of about SAMPLE documents
that pass the base test. A rule pays only for what it adds: measures that the base test or the result needs anyway are there
before. The cascade is then built step by step: next comes the rule that rejects most per cost among the sampled
documents that the rules before it leave. A document meets no further rule after the first that rejects it. The order changes what is computed, never the verdict: a
document is kept if the base test passes and no rule rejects it.

Rules (thresholds are parameters of RULES): many symbols; half of the lines repeat earlier ones; odd mean word
length; half of the words shouted; many exclamation marks; many words without a letter.

Defined results: a null or empty text has no words and fails the base test. Rows are judged one by
one, so repeated rows give equal rows. Columns beyond doc_id and text are ignored. Of an empty table
nothing is estimated and no row is returned.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare

SAMPLE = 2000
MIN_WORDS = 50
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


class Document:
    """A text with the measures that rules share, each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self.words = text.split()

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"#*$%&|<>"))

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode())

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those equal to an earlier one."""
        lines = [x for x in self.text.split(b"\n") if x.split()]
        return len(lines), len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count, covered, last = Counter(windows), 0, -1
        for i, x in enumerate(windows):
            if count[x] > 1:
                covered += i + 2 - max(last, i - 1)
                last = i + 2
        return covered

    @property
    def base_failed(self) -> bool:
        return len(self.words) < MIN_WORDS or 100 * self.n_repeat_words > 50 * len(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    limit: float
    high: float | None = None

    def rejects(self, d: Document) -> bool:
        n = len(d.words)
        if self.name == "symbols":
            return d.n_symbols > self.limit * n
        if self.name == "duplicate_lines":
            return d.lines[1] > self.limit * d.lines[0]
        if self.name == "word_length":
            return not self.limit * n <= d.word_chars <= self.high * n
        if self.name == "shouting":
            return sum(map(bytes.isupper, d.words)) > self.limit * n
        if self.name == "exclamations":
            return d.text.count(b"!") > self.limit * n
        if self.name == "letterless":
            return sum(not LETTER.search(w) for w in d.words) > self.limit * n
        raise ValueError(self.name)


RULES = (Rule("symbols", 0.125), Rule("duplicate_lines", 0.5), Rule("word_length", 3, 10), Rule("shouting", 0.5), Rule("exclamations", 0.25), Rule("letterless", 0.25))


#: Measures that the result holds, whatever the rules ask for.
REPORTED = ("word_chars", "n_symbols", "lines")


def _measured(rules: tuple[Rule, ...], given: tuple[str, ...]):
    def measure(batches):
        found: dict[int, list[float]] = {}
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                d = Document(text)
                if d.base_failed:
                    continue
                for name in given:
                    getattr(d, name)
                mask, seconds = 0, []
                for i, rule in enumerate(rules):
                    began = time.thread_time()
                    mask |= rule.rejects(d) << i
                    seconds.append(time.thread_time() - began)
                sums = found.setdefault(mask, [0.0] * (len(rules) + 1))
                for i, x in enumerate([1.0, *seconds]):
                    sums[i] += x
        columns = {"mask": list(found), "seen": [int(x[0]) for x in found.values()]} | {f"s{i}": [x[i + 1] for x in found.values()] for i in range(len(rules))}
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if c in ("mask", "seen") else pa.float64()) for c, x in columns.items()], names=list(columns))

    return measure


def _masks(docs: DataFrame, rules: tuple[Rule, ...], sample: int, given: tuple[str, ...]) -> DataFrame:
    """(mask, seen, s0, s1, ...): sampled documents by the set of rules that reject them, and the seconds of each rule; at most 2 ** rules rows."""
    share = min(1.0, sample / max(1, docs.count()))
    seconds = [f"s{i}" for i in range(len(rules))]
    counts = docs.sample(share, seed=7).select("text").mapInArrow(_measured(rules, given), ", ".join(["mask long, seen long", *(f"{c} double" for c in seconds)]))
    return counts.groupBy("mask").agg(*[F.sum(c).alias(c) for c in ("seen", *seconds)])


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, given: tuple[str, ...] = ()) -> DataFrame:
    """(rule, seconds, rejected, seen) over the documents of a sample of about ``sample`` that pass the base test."""
    per = [F.struct(F.lit(r.name).alias("rule"), F.sum(f"s{i}").alias("seconds"), F.sum(F.when(F.getbit("mask", F.lit(i)) == 1, F.col("seen")).otherwise(0)).alias("rejected"), F.sum("seen").alias("seen")) for i, r in enumerate(rules)]
    return _masks(docs, rules, sample, given).agg(F.array(*per).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, given: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules, each the best by rejections per second among the documents that those before it leave."""
    rows = _masks(docs, rules, sample, given).collect()
    cost = [sum(r[f"s{i}"] for r in rows) / max(1, sum(r["seen"] for r in rows)) + 1e-9 for i in range(len(rules))]
    left, order = list(rows), []
    while len(order) < len(rules):
        gain = {i: sum(r["seen"] for r in left if r["mask"] >> i & 1) for i in range(len(rules)) if i not in order}
        best = min(gain, key=lambda i: (-gain[i] / cost[i], cost[i], rules[i].name))
        order.append(best)
        left = [r for r in left if not r["mask"] >> best & 1]
    return tuple(rules[i] for i in order)


def _judged(rules: tuple[Rule, ...]):
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}

    def judge(batches):
        for batch in batches:
            texts, ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                d = Document(text)
                failed = d.base_failed
                by = "base" if failed else next((r.name for r in rules if r.rejects(d)), None)
                rows.append((doc_id, len(d.words), d.word_chars, d.n_symbols, d.lines[1], d.n_repeat_words, failed, by is None, by))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.int64())) for c, x in zip(names, columns, strict=True)], names=names)

    return judge


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per document: measures, the verdict, and the rule that rejected it first in this run's order."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_judged(ordered(docs, rules, sample, REPORTED)), RESULT)


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows that pass, with all their columns."""
    prepare(docs.sparkSession)
    order, names = ordered(docs, rules, sample), docs.columns

    def keep(batches):
        for batch in batches:
            good = []
            for text in as_bytes(batch.column("text")):
                d = Document(text)
                good.append(not d.base_failed and not any(r.rejects(d) for r in order))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.select(*names).mapInArrow(keep, docs.schema)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, len(words) AS n,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS shouted,
    len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS letterless,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS exclaimed
  FROM w),
v AS (
  SELECT m.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n < 50 OR 100 * n_repeat_words > 50 * n) AS base_failed,
  NOT (n < 50 OR 100 * n_repeat_words > 50 * n OR n_symbols > 0.125 * n OR n_dup_lines > 0.5 * len(lines) OR word_chars < 3 * n OR word_chars > 10 * n
    OR shouted > 0.5 * n OR exclaimed > 0.25 * n OR letterless > 0.25 * n) AS kept
FROM v
"""
