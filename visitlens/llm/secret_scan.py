"""Secrets in texts: fixed shapes, and values beside credential words that are too costly to guess to be prose.

Base spans: ``assign`` (a credential word, a sign, a value of 6 characters or more), ``access`` (key ids that begin with AKIA, 20 characters or more) and ``hex``
(24 lower-case digits or more), each leftmost and non-overlapping.

The method adds ``guess`` spans: values in wider credential contexts (further words and languages, passwords in URLs, any printable characters) whose guess cost is
``MIN_GUESSES`` powers of ten or more. The cost is the least over all segmentations of a value into words, dates, repeats, keyboard or alphabet walks and
brute-force spans, found by dynamic programming from left to right: a segment costs what an attacker tries to find it, and each further
one the choice of its kind. A word costs its rank, so prose is cheap and random characters are not. Ranks come from the corpus itself: letters-only words of all
texts outside of credential values are counted, and the first ``WORDS`` of them, a bounded table, go to the tasks after some well-known passwords.
A value within a base span adds no span of its own; references such as ``${NAME}`` or ``get_token()`` aren't values.

Defined results: a null or empty text has no span. Rows are judged one by one, so repeated rows give equal rows. Only doc_id (null too) and text are
read. Of an empty table nothing is counted and no row is returned. Texts and values are read whole, at a cost in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare, written

MIN_GUESSES = 12.0
WORDS = 100_000
LONGEST_WORD = 24
KINDS = ("assign", "access", "hex", "guess")

# ---- where values stand ---------------------------------------------------------------------

ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Any text with an assign or a credential context holds one of these in lower case.
CUES = tuple(x.encode() for x in ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "kennwort", "contrase", "clave"))
_NAMES = r"pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|(?:api|access|private|secret)[ _-]?key|credentials?|auth(?:orization)?|bearer|kennwort|contrase(?:ñ|Ñ|n)a|clave|mot de passe"
CONTEXT = re.compile(rf"(?<![A-Za-z])(?i:(?:[a-z]{{2,12}}[_-]){{0,3}}(?:{_NAMES}))[\"']?[ \t]{{0,4}}(?:=>|:=|[:=]|(?i:is|ist|est|es)(?=[ \t]))[ \t]{{0,4}}(?:(?i:bearer|basic)[ \t]{{1,4}})?[\"'`]?([^\x00-\x20\"'`<>]+)".encode())
IN_URL = re.compile(rb"://[^\x00-\x20/:@]+:([^\x00-\x20/@]+)@")
REFERENCE = re.compile(rb"^[$%]\w+%?$|\$\{|\{\{|^[\w.:>-]+[(\[]|^\*+$|^[xX.]+$")
_TAIL = b",.;:!?|"


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes."""
    found = [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    if any(c in low for c in (b"passw", b"secret", b"token", b"api")):
        found += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return sorted(found)


def values(text: bytes, low: bytes) -> list[tuple[int, int]]:
    """Places of the values in credential contexts, in bytes, without what ends a sentence."""
    found = set()
    patterns = ([CONTEXT] if any(c in low for c in CUES) else []) + ([IN_URL] if b"://" in low else [])
    for pattern in patterns:
        for m in pattern.finditer(text):
            value = m[1].rstrip(_TAIL)
            if len(value) >= 6 and not REFERENCE.search(value):
                found.add((m.start(1), m.start(1) + len(value)))
    return sorted(found)


# ---- what a value costs to guess ------------------------------------------------------------

#: Passwords that every attacker tries first.
COMMON = ["password", "qwerty", "letmein", "welcome", "admin", "changeme", "secret", "dragon", "monkey", "master", "login", "iloveyou", "sunshine", "princess", "football", "baseball", "shadow", "superman", "trustno", "default", "guest", "root", "test", "pass", "hello", "passwort", "hallo", "azerty", "motdepasse", "hola"]
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = (bytes.maketrans(b"0134578@$!", b"oieastbasi"), bytes.maketrans(b"0134578@$!", b"oleastbasi"))
DATES = [(re.compile(p), c) for p, c in ((rb"(?:19|20)\d\d", log10(150)), (rb"\d\d?([-./]?)\d\d?\1(?:19|20)?\d\d", log10(365 * 150 * 4)), (rb"(?:19|20)\d\d([-./]?)\d\d?\1\d\d?", log10(365 * 150 * 4)))]
KIND_CHOICE = log10(5)
MAX_PERIOD, NEAR_ENDS = 16, 32
CLASSES = ((b"0123456789", 10), (b"abcdefghijklmnopqrstuvwxyz", 26), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
_PLACE = {c: (r, x) for r, row in enumerate(ROWS) for x, c in enumerate(row.encode())}


def _step(a: int, b: int) -> tuple[int, int] | None:
    """The direction of a step between neighbouring keys, or between neighbours in the alphabet (row 9); keys of the row below lie half a key to the right."""
    if a in _PLACE and b in _PLACE:
        dr, dx = _PLACE[b][0] - _PLACE[a][0], _PLACE[b][1] - _PLACE[a][1]
        if (dr, dx) in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
            return dr, dx
    if 97 <= a <= 122 and 97 <= b <= 122 and abs(b - a) == 1:
        return 9, b - a
    return None


def alphabet(value: bytes) -> int:
    """Characters an attacker has to try at each place: the sum of the kinds that the value has."""
    rest = value
    total = 0
    for members, size in CLASSES:
        less = rest.translate(None, members)
        total, rest = total + size * (len(less) < len(rest)), less
    return total + (33 if any(c < 128 for c in rest) else 0) + (64 if any(c >= 128 for c in rest) else 0)


@dataclass
class Guesser:
    """Guess costs with the ranks of words (1 is tried first)."""

    ranks: dict[bytes, int]
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ranks), default=0)

    def word(self, text: bytes) -> float | None:
        """Cost of a text as one word, with capitals or figures for letters."""
        low = text.lower()
        rank, extra = self.ranks.get(low), 0.0
        if rank is None:
            plain = [(low.translate(t), sum(x != y for x, y in zip(low, low.translate(t), strict=True))) for t in LEET]
            known = [(self.ranks[w], n) for w, n in plain if n and 2 * n <= len(text) and w in self.ranks]
            if not known:
                return None
            rank, n = min(known)
            extra = n * log10(2)
        capitals = sum(65 <= c <= 90 for c in text)
        if capitals:
            extra += log10(2) if capitals == len(text) or (capitals == 1 and 65 <= text[0] <= 90) else capitals * log10(2) + log10(2)
        return log10(rank + 1) + extra

    def spans(self, value: bytes, periods: int = MAX_PERIOD):
        """(start, end, cost, kind) of every segment but brute force."""
        n, low = len(value), value.lower()
        spelt = {low, *(low.translate(t) for t in LEET)}
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if any(x[i:j] in self.ranks for x in spelt):
                    cost = self.word(value[i:j])
                    if cost is not None:
                        yield i, j, cost, "word"
            for pattern, cost in DATES:
                m = pattern.match(value, i)
                if m:
                    yield i, m.end(), cost, "date"
        steps = [_step(a, b) for a, b in zip(low, low[1:], strict=False)]
        end = 0
        for i in range(n - 2):
            # walks: from each place on, ends near it and the last one
            if end <= i or not steps[i]:
                end = i
                while end < n - 1 and steps[end]:
                    end += 1
            turns = 0
            for j in range(i, min(end, i + NEAR_ENDS)):
                turns += j > i and steps[j] != steps[j - 1]
                if j - i >= 1:
                    yield i, j + 2, log10(len(_PLACE)) + turns * log10(5) + log10(j + 2 - i), "walk"
        yield from self._long_walks(steps)
        for p in range(1, min(periods, n // 2) + 1):
            start = 0
            for i in range(n - p + 1):
                if i == n - p or value[i] != value[i + p]:
                    if i - start >= max(p, 2):
                        whole = (i - start) // p * p + p
                        yield start, start + whole, self.cost(value[start : start + p], 0)[0] + log10(whole // p), "repeat"
                    start = i + 1

    def _long_walks(self, steps: list):
        """Whole walks that go on beyond the near ends."""
        i = 0
        while i < len(steps):
            j = i
            while j < len(steps) and steps[j]:
                j += 1
            if j - i > NEAR_ENDS:
                turns = sum(a != b for a, b in zip(steps[i:j], steps[i + 1 : j], strict=False))
                yield i, j + 1, log10(len(_PLACE)) + turns * log10(5) + log10(j + 1 - i), "walk"
            i = j + 1

    def cost(self, value: bytes, periods: int = MAX_PERIOD) -> tuple[float, list[tuple[str, bytes]]]:
        """Least log10 of guesses over all segmentations, and the segments of one that has it."""
        n, each = len(value), log10(max(alphabet(value), 1))
        by_end: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        for i, j, cost, kind in self.spans(value, periods):
            by_end[j].append((i, cost, kind))
        # least cost up to each place whose last segment is closed, or an open brute-force span; and where that segment began
        closed, opened, came, began = [0.0] * (n + 1), [np.inf] * (n + 1), [(0, "")] * (n + 1), [0] * (n + 1)
        choice = lambda i: KIND_CHOICE if i else 0.0
        for j in range(1, n + 1):
            fresh = closed[j - 1] + choice(j - 1) + each
            opened[j], began[j] = min((opened[j - 1] + each, began[j - 1]), (fresh, j - 1))
            closed[j], came[j] = opened[j], (began[j], "brute force")
            for i, cost, kind in by_end[j]:
                if closed[i] + choice(i) + cost < closed[j]:
                    closed[j], came[j] = closed[i] + choice(i) + cost, (i, kind)
        parts, j = [], n
        while j:
            i, kind = came[j]
            parts.append((kind, value[i:j]))
            j = i
        return closed[n], parts[::-1]


# ---- the corpus' words ----------------------------------------------------------------------

_WORD = re.compile(rb"[a-z\x80-\xff]{3,%d}" % LONGEST_WORD)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def _count(batches):
    for batch in batches:
        counts: Counter[bytes] = Counter()
        for text in as_bytes(batch.column("text")):
            low, at, rest = text.lower(), 0, []
            for start, end in values(text, low):
                rest.append(text[at:start])
                at = max(at, end)
            counts.update(b" ".join([*rest, text[at:]]).translate(_PLAIN).split())
        kept = [(w, n) for w, n in counts.items() if _WORD.fullmatch(w)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def learn_words(docs: DataFrame, words: int = WORDS) -> Guesser:
    """Ranks by how often the whole corpus has a word; ``words`` of them, ties by their bytes."""
    counts = written(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # steps of a hundredth of e: some 4,400 for any counts; what is sorted are the words above the step where the first ``words`` end
    step = F.floor(F.ln("n") * 100)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).toArrow().sort_by([("step", "descending")]).to_pylist()
    above = list(accumulate(x["n"] for x in sizes))
    least = next((x["step"] for x, n in zip(sizes, above, strict=True) if n >= words), -1)
    ranked = counts.filter(step >= least).orderBy(F.col("n").desc(), "word").limit(words).select("word").toArrow()["word"].to_pylist()
    first = [x.encode() for x in COMMON]
    return Guesser({w: i + 1 for i, w in enumerate(dict.fromkeys([*first, *ranked]))})


# ---- scanning -------------------------------------------------------------------------------


def scan(text: bytes, guesser: Guesser, least: float = MIN_GUESSES) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, log10 of the value's guesses) in bytes, by start and kind; key ids and hex digits aren't costed."""
    low = text.lower()
    base = base_spans(text, low)
    found = [(start, kind, end, guesser.cost(text[value:end])[0] if kind == 0 else None) for start, kind, end, value in base]
    reach, last, nearest = 0, 0, sorted((s, e) for s, _, e, _ in base)
    for start, end in values(text, low):
        while last < len(nearest) and nearest[last][0] <= start:
            reach = max(reach, nearest[last][1])
            last += 1
        if reach < end:
            cost = guesser.cost(text[start:end])[0]
            if cost >= least:
                found.append((start, 3, end, cost))
    return sorted(found, key=lambda x: x[:3])


def _points(text: bytes):
    """Byte places to code points."""
    if text.isascii():
        return lambda at: at
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return lambda at: int(before[at])


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())])
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind: string, start: long, end: long, guesses: double>>"


def scan_secrets(docs: DataFrame, least: float = MIN_GUESSES, words: int = WORDS) -> DataFrame:
    """One row a document: counts of the base kinds, their digest, all spans (code points, end exclusive) as text and as findings with their guess cost."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(learn_words(docs, words))

    def work(batches):
        guesser = sent.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                spans = scan(text, guesser, least)
                point = _points(text) if spans else None
                found = [{"kind": KINDS[k], "start": point(s), "end": point(e), "guesses": g} for s, k, e, g in spans]
                listed = [f"{f['kind']}:{f['start']}:{f['end']}" for f in found]
                base = ",".join(x for x, f in zip(listed, found, strict=True) if f["kind"] != "guess")
                n = Counter(f["kind"] for f in found)
                rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(listed), found))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(_FINDING)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, RESULT)
