"""Phrase collocations of each language, by Rabin-Karp fingerprints.

Words get polynomial codes from prefix sums over bytes, and prefix sums of those give the fingerprint of every n-gram in numpy. Fingerprints and
where one occurrence stands are what a shuffle aggregates, summed within each slice of texts and each task first. The texts are read five times:

1. words, with their text, and how many words each language has;
2. fingerprints of the word pairs whose two words are frequent;
3. pairs and triples whose pairs are all frequent (an n-gram is no more frequent than its parts): fingerprint, count, an occurrence pointer (a code of one
   place in one document), and the least and greatest of a second, independent fingerprint of 32 bits;
4. likewise four and five words whose triples are all frequent: longer n-grams are looked for where shorter ones were found alone;
5. the text at the pointers of frequent fingerprints: a phrase is written out once.

Where the second fingerprint's least and greatest differ, a fingerprint has several texts; another scan counts those by their text, compared word by word
with what each slice's group points to. So a count is wrong only if two texts agree in 96 bits.

What a task holds is bounded, whatever the input: texts come in batches of ``BATCH`` bytes (or one longer text), counted n-grams are merged in place up to
``HELD``, and rows go back in batches of ``ROWS``, since the JVM takes each batch whole beside its heap.

"Frequent" travels as a bit for each fingerprint (or pointer) modulo ``FILTER_BITS``, 16 MB whatever the input. A set bit of another one
only sends more to the next shuffle; it never changes a count.

Defined results: a null text is empty, a null language is ``und``, and the two share their counts. Repeated rows count as often as they
stand there. Only doc_id, lang and text are read, further columns are ignored; doc_id (null too) serves pointers and examples alone.
Phrases with equal score and count are in UTF-8 byte order. Of an empty table no row is returned. A word may be of any length.
"""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODES, Runs, as_bytes, joined, mixed, partitions, prepare, slices, word_codes, written

MIN_COUNT = 100
LONGEST = 5
#: How many lengths of n-grams are counted by one reading of the texts.
STEP = 2
SHARE = 100
TOP = 2000
FILTER_BITS = 1 << 27
#: Bytes of a slice (powers up to this size stay at hand), and how many entries are gathered from slices before they are summed.
SLICE, GATHERED = 900_000, 1 << 21
#: Counted n-grams that a task holds before it hands them on, tasks a core, and how many partitions of the input one such task may read.
HELD, WAVES, MERGED = 1 << 20, 2, 8
#: Bytes of a batch of texts that goes to a task, rows of a batch that comes back.
BATCH, ROWS = 4 << 20, 1 << 16
SALTS = 64
UNKNOWN = "und"
SECOND_CODES = mixed(BYTE_CODES * np.uint64(3))
#: A-Z as a-z, the ends of pieces as line feeds, tabs as spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class Slice:
    """The words of some texts: codes that tell languages apart, pieces, places."""

    def __init__(self, texts: list[bytes], langs: list[str], width: int = 64):
        self.data, starts = joined([t.translate(_FOLD) + b"\n" for t in texts])
        gap = (self.data == 0x20) | (self.data == 0x0A)
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
        self.first, self.last, self.width = edge[0::2], edge[1::2], width
        runs = Runs(BYTE_CODES[self.data])
        self.pieces = np.cumsum(self.data == 0x0A)[self.first]
        self.texts = np.searchsorted(starts, self.first, side="right") - 1
        self.first_word = np.searchsorted(self.first, starts)
        self.names, seeds, of_text = _languages(langs)
        self.langs = of_text[self.texts]
        self.seeds = seeds[self.langs]
        self.codes = mixed(runs.between(self.first, self.last) ^ self.seeds)
        self.whole = runs.between(starts[:-1], starts[1:])

    def second_codes(self) -> np.ndarray:
        """Word codes of another polynomial."""
        return mixed(Runs(SECOND_CODES[self.data]).between(self.first, self.last) ^ self.seeds)

    def grams(self, n: int, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the n-gram at each place, and whether one piece holds it."""
        if len(self.codes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        one_piece = self.pieces[n - 1 :] == self.pieces[: len(self.pieces) - n + 1]
        if codes is not None:
            return mixed(Runs(codes).of(n) + np.uint64(n)), one_piece
        prints = self.codes if n == 1 else mixed(Runs(self.codes).of(n) + np.uint64(n))
        return prints & np.uint64((1 << self.width) - 1), one_piece

    def places(self, at: np.ndarray, ids: list) -> np.ndarray:
        """Codes of places, 32 bits of document, whole text and word: they have to tell apart the occurrences of one fingerprint."""
        of_doc = mixed(np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64) + np.uint64(1))
        doc = self.texts[at]
        return mixed(mixed(self.whole ^ of_doc)[doc] + (at - self.first_word[doc]).astype(np.uint64)) >> np.uint64(32)

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.first[at : at + n].tolist(), self.last[at : at + n].tolist(), strict=True)])

    def groups(self, n: int, at: np.ndarray, prints: np.ndarray):
        """(pointers, counts) of the n-grams at these places told apart by their text: each is compared with the one its group points to, the others come in a later turn."""
        texts = {i: self.phrase(i, n) for i in at.tolist()}
        while len(at):
            _, pointer, group = np.unique(np.stack([prints[at], self.langs[at].astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
            group = group.reshape(-1)
            pointed = at[pointer]
            same = np.fromiter((texts[i] == texts[j] for i, j in zip(at.tolist(), pointed[group].tolist(), strict=True)), bool, len(at))
            yield pointed, np.bincount(group[same], minlength=len(pointer))
            at = at[~same]


def _languages(langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the languages, a code of each, and the number of each text's."""
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    return names, mixed(word_codes([b"#" + x.encode().hex().encode() for x in names])[0]), np.fromiter((place[x] for x in langs), np.int64, len(langs))


def _texts(batches):
    """Slices of whole texts with their languages and ids."""
    for batch in batches:
        texts, ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
        langs = [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]
        for a, b in slices(texts, SLICE):
            yield texts[a:b], langs[a:b], ids[a:b]


def _table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _tables(schema: pa.Schema, *columns):
    """Rows in batches of at most ``ROWS``."""
    for a in range(0, len(columns[0]), ROWS):
        yield _table(schema, *[c[a : a + ROWS] for c in columns])


@contextmanager
def _small_batches(spark: SparkSession):
    """Meanwhile texts go to tasks in batches of about ``BATCH`` bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_WORDS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])
_CODED = pa.schema([*_WORDS, ("code", pa.int64())])
_PRINTS = pa.schema([("code", pa.int64()), ("f", pa.int64())])
_POINTERS = pa.schema([*_PRINTS, ("place", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_TEXTS = pa.schema([("code", pa.int64()), ("place", pa.int64()), ("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64())])
_SQL = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int"}


def _scan(docs: DataFrame, work, schema: pa.Schema) -> DataFrame:
    return docs.mapInArrow(work, ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema))


def _merged(texts: DataFrame) -> DataFrame:
    """The texts in fewer and larger tasks, so that more is summed before the shuffle: a frequent n-gram costs it a row for each task."""
    least = WAVES * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(max(least, -(-texts.rdd.getNumPartitions() // MERGED)))


def _gathered(parts, limit: int = GATHERED):
    """Arrays of several slices as one, which isn't kept here."""
    held, size = [], 0

    def whole():
        found = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return found

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= limit:
            size = 0
            yield whole()
    if size:
        yield whole()


def _count_words(batches):
    """Words of each language with their text, counted."""
    counts: dict[str, Counter] = {}

    def flush():
        while counts:
            name, found = counts.popitem()
            yield from _tables(_WORDS, [name] * len(found), list(found), list(found.values()))

    for texts, langs, _ in _texts(batches):
        names, _, of_text = _languages(langs)
        for i, name in enumerate(names):
            counts.setdefault(name, Counter()).update(b"\n".join([texts[j] for j in np.flatnonzero(of_text == i).tolist()]).translate(_FOLD).split())
        if sum(map(len, counts.values())) > GATHERED // 8:
            yield from flush()
    yield from flush()


def _code_words(batches):
    """Counted words with their codes."""
    for batch in batches:
        names, seeds, of_row = _languages(batch.column("lang").to_pylist())
        codes = mixed(word_codes(batch.column("phrase").to_pylist())[0] ^ seeds[of_row])
        yield _table(_CODED, *[batch.column(c) for c in _WORDS.names], codes.view(np.int64))


def _bits(packed: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints pass a filter."""
    place = prints & np.uint64(len(packed) * 64 - 1)
    return (packed[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _starts(prints: np.ndarray) -> np.ndarray:
    """Where each value of sorted ones stands first."""
    first = np.ones(len(prints), bool)
    np.not_equal(prints[1:], prints[:-1], out=first[1:])
    return np.flatnonzero(first)


def _count_pairs(words, width: int):
    """Counts of the pairs whose two words pass."""

    def pairs(batches):
        for texts, langs, _ in _texts(batches):
            s = Slice(texts, langs, width)
            prints, ok = s.grams(2)
            frequent = _bits(words.value, s.codes)
            yield (prints[ok & frequent[1:] & frequent[:-1]] if len(prints) else prints,)

    def count(batches):
        for (prints,) in _gathered(pairs(batches)):
            prints.sort()
            start = _starts(prints)
            yield from _tables(_PRINTS, prints[start].view(np.int64), np.diff(start, append=len(prints)))

    return count


def _folded(prints, places, second) -> list[np.ndarray]:
    """One entry for each fingerprint, in order: its count, its least place, the range of its second fingerprints."""
    order = np.argsort(prints, kind="stable")
    prints, places, second = prints[order], places[order], second[order]
    start = _starts(prints)
    least = np.minimum.reduceat
    return [prints[start], np.diff(start, append=len(prints)), least(places, start), least(second, start), np.maximum.reduceat(second, start)]


def _merge(held: list[np.ndarray], found: list[np.ndarray]) -> None:
    """Other folded entries into the held ones, column by column: only one is there twice at a time."""
    at = np.searchsorted(held[0], found[0])
    known = held[0][np.minimum(at, len(held[0]) - 1)] == found[0]
    for i, fold in enumerate((np.add, np.minimum, np.minimum, np.maximum), 1):
        held[i][at[known]] = fold(held[i][at[known]], found[i][known])
    for i, column in enumerate(found):
        held[i] = np.insert(held[i], at[~known], column[~known])


def _count_grams(parts, size: int, sizes: range, width: int):
    """Counts, pointers and second fingerprints of the n-grams whose parts of ``size`` words all pass."""

    def grams(batches):
        for texts, langs, ids in _texts(batches):
            s = Slice(texts, langs, width)
            frequent, second = _bits(parts.value, s.grams(size)[0]), s.second_codes()
            for n in sizes:
                prints, ok = s.grams(n)
                for j in range(n - size + 1):
                    ok = ok & frequent[j : j + len(prints)]
                at = np.flatnonzero(ok)
                if len(at):
                    yield prints[at], s.places(at, ids).astype(np.uint32), (s.grams(n, second)[0][at] >> np.uint64(32)).astype(np.uint32)

    def count(batches):
        held = []
        for found in map(lambda x: _folded(*x), _gathered(grams(batches), HELD // 4)):
            if held:
                _merge(held, found)
            else:
                held = found
            if len(held[0]) >= HELD:
                yield from _tables(_POINTERS, held[0].view(np.int64), *held[1:])
                held = []
        if held:
            yield from _tables(_POINTERS, held[0].view(np.int64), *held[1:])

    return count


def _found(s: Slice, n: int, where: np.ndarray, prints: np.ndarray, places: np.ndarray, f: np.ndarray, ids: list) -> pa.RecordBatch:
    doc = s.texts[where]
    return _table(_TEXTS, prints[where].view(np.int64), places.view(np.int64), [s.names[i] for i in s.langs[where]], np.full(len(where), n, np.int32), [s.phrase(i, n) for i in where.tolist()], f, [ids[i] for i in doc], where - s.first_word[doc])


def _read_pointers(codes, places, sizes: range, width: int):
    """Texts at the places that are pointed to."""

    def read(batches):
        for texts, langs, ids in _texts(batches):
            s = Slice(texts, langs, width)
            for n in sizes:
                prints, ok = s.grams(n)
                at = np.flatnonzero(ok)
                at = at[_bits(codes.value, prints[at])]
                where = s.places(at, ids)
                hit = _bits(places.value, where)
                yield _found(s, n, at[hit], prints, where[hit], np.zeros(hit.sum(), np.int64), ids)

    return read


def _count_texts(codes, sizes: range, width: int):
    """Counts by text of the n-grams whose fingerprint passes."""

    def count(batches):
        for texts, langs, ids in _texts(batches):
            s = Slice(texts, langs, width)
            for n in sizes:
                prints, ok = s.grams(n)
                at = np.flatnonzero(ok)
                for where, f in s.groups(n, at[_bits(codes.value, prints[at])], prints):
                    yield _found(s, n, where, prints, s.places(where, ids), f, ids)

    return count


def _filter(rows: DataFrame, bits: int, column: str = "code") -> np.ndarray:
    """One bit a code, modulo ``bits``: at most bits / 64 rows of 64 bits reach the driver."""
    place = F.col(column).bitwiseAND(bits - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    found = rows.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    packed = np.zeros(bits // 64, np.uint64)
    packed[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return packed


def _share_of(left: DataFrame, counts: DataFrame, phrase: str, name: str) -> DataFrame:
    """The count of a part of each phrase, joined by language and text."""
    return left.join(counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(name)), ["lang", phrase])


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


@dataclass(frozen=True)
class Counts:
    """What the texts hold: words and frequent phrases of each language with their counts, and its number of words."""

    words: DataFrame
    phrases: DataFrame
    totals: DataFrame


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int = FILTER_BITS, width: int = 64) -> Counts:
    """Exact counts of all words, and of all phrases of 2 to ``longest`` words with at least ``min_count`` occurrences.

    Phrases are binary (UTF-8, words joined by one space), with a place (doc_id, word) as an example. ``width`` is that of the first fingerprint; tests make it small.
    """
    spark = prepare(docs.sparkSession)
    sent = []

    def send(rows: DataFrame, column: str = "code"):
        sent.append(spark.sparkContext.broadcast(_filter(rows, bits, column)))
        return sent[-1]

    texts, sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), range(2, longest + 1)
    words = written(_scan(_scan(texts, _count_words, _WORDS).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), _code_words, _CODED))
    many = F.col("f") >= min_count
    pairs = _scan(texts, _count_pairs(send(words.filter(many)), width), _PRINTS).groupBy("code").agg(F.sum("f").alias("f")).filter(many)
    steps, parts, size = [], pairs, 2
    for least in sizes[::STEP]:
        of_step = range(least, min(least + STEP, longest + 1))
        grams = _scan(_merged(texts), _count_grams(send(parts), size, of_step, width), _POINTERS).groupBy("code")
        found = written(grams.agg(F.sum("f").alias("f"), F.min("place").alias("place"), F.min("low").alias("low"), F.max("high").alias("high")).filter(many))
        steps.append(found.withColumn("step", F.lit(len(steps))))
        while sent:
            sent.pop().unpersist()
        parts, size = found, of_step[-1]
    frequent, step = reduce(DataFrame.unionByName, steps), F.expr(f"(n_words - 2) div {STEP}").cast("int")
    alone, mixed_up = frequent.filter("low = high"), frequent.filter("low <> high")
    example = F.struct("doc_id", "word").alias("example")
    at = _scan(texts, _read_pointers(send(alone), send(alone, "place"), sizes, width), _TEXTS).drop("f").withColumn("step", step)
    phrases = at.join(alone.select("code", "step", "place", "f"), ["code", "step", "place"]).groupBy("code", "step").agg(F.min(F.struct("lang", "n_words", "phrase", "f", example)).alias("x")).select("x.*")
    if not mixed_up.isEmpty():
        by_text = _scan(texts, _count_texts(send(mixed_up), sizes, width), _TEXTS).withColumn("step", step).join(mixed_up.select("code", "step"), ["code", "step"], "left_semi")
        phrases = phrases.unionByName(by_text.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"), F.min(example).alias("example")).filter(many))
    phrases = written(phrases)
    for filter_ in sent:
        filter_.unpersist()
    return Counts(words.select("lang", "phrase", "f"), phrases, words.groupBy("lang").agg(F.sum("f").alias("n")))


def score_phrases(counts: Counts, share: int = SHARE) -> DataFrame:
    """Phrases with a, l, r, n and the score of their weakest cut; those inside a longer phrase with at least ``share`` percent of their count are left out.

    Products are decimals of 38 digits: exact while 1000 * a * n stays below 10^38.
    """
    phrases = counts.phrases
    parts = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    split = phrases.withColumn("w", F.split(F.col("phrase").cast("string"), " "))
    inside = [F.when((F.col("n_words") > m) & (F.col("n_words") >= i + m - 1), parts(i, m)) for m in range(2, LONGEST) for i in range(1, LONGEST - m + 2)]
    held = F.array_compact(F.array(*inside))
    above = split.select("lang", F.explode(held).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above")).withColumn("phrase", F.col("phrase").cast("binary"))
    kept = split.join(above, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < share * F.col("f")))
    cuts = kept.select("lang", "phrase", "n_words", "w", F.col("f").alias("a"), "example", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": parts(1, F.col("k")).cast("binary"), "right": parts(F.col("k") + 1, F.col("n_words") - F.col("k")).cast("binary")}).drop("w")
    known = counts.words.unionByName(counts.phrases.select("lang", "phrase", "f"))
    both = _share_of(_share_of(cuts, known, "left", "l"), known, "right", "r").join(counts.totals, "lang")
    score = F.call_function("div", _exact("a") * F.lit(1000).cast("decimal(4,0)") * F.col("n").cast("decimal(14,0)"), _exact("l") * F.col("r").cast("decimal(18,0)"))
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    found = both.groupBy("lang", "phrase").agg(least, F.first("a").alias("a"), F.first("n").alias("n"), F.first("example").alias("example"))
    return found.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", F.col("cut.k").alias("cut_after"), F.col("example.doc_id").alias("example_doc"), F.col("example.word").alias("example_word"))


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first phrases of each language with their rank: first within parts of a language, dealt by a hash, then over what these leave."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(max(SALTS, partitions(scored.sparkSession))))
    rank = lambda *by: F.expr(f"row_number() over (partition by {', '.join(by)} order by score desc, a desc, phrase)")
    few = scored.withColumn("_salt", salt).withColumn("_rank", rank("lang", "_salt")).filter(F.col("_rank") <= top).drop("_salt", "_rank")
    ranked = few.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", *[c for c in scored.columns if c != "lang"])


def mine_collocations(docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, where the weakest cut is, and an example's place."""
    with _small_batches(docs.sparkSession):
        counts = count_phrases(docs, min_count, LONGEST, bits)
    return best(score_phrases(counts, share), top)
