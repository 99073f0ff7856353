"""Exact substring deduplication of bytes by a depth-limited radix sort of suffixes.

Suffixes need no order beyond THRESHOLD bytes: two that agree so far are a repeated window, and
which of them is the smaller doesn't matter. So suffixes are split by most-significant digits, a
suffix that is alone in its group drops out, and the groups left at full depth are exactly the
repeated windows. Groups live in buckets over the whole cluster (see repeats.py).

* First digit, DIGIT bytes. Within any window, the place whose digit has the least code is the
  same in all copies of the window, so only the suffixes at these places (about one in seventy) are dealt
  out by their digit, each with a code of the stretch of all windows that share it. A digit
  found once rules its windows out. If it stands in one and the same stretch everywhere, the
  group needs no further digit: all its windows are repeated.
* Remaining digits, to THRESHOLD bytes, for the groups that hold different stretches: their
  suffixes, each distinct one of a chunk once.

Defined results: a null text is empty; a text under THRESHOLD bytes keeps all. Every row counts as a
document of its own, so a row that repeats another loses whatever lies in a window. Columns beyond
doc_id and text are ignored. Groups are told apart by 64-bit codes of their digits.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats as R
from .common import BYTE_CODES, Runs, as_bytes, covered, joined, places_left, prepare

THRESHOLD = 200
DIGIT = 64
#: A kind of answer beside those of repeats.py: windows found again in the last pass.
AT_FULL_DEPTH = 2
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_text string, kept_sha256 string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def least(codes: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least code among the ``width`` from each place, by doubling."""
    at = np.arange(len(codes), dtype=np.int32)
    size = 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(codes[b] < codes[a], b, a)
        size *= 2
    if rest := width - size:
        a, b = at[:-rest], at[rest:]
        at = np.where(codes[b] < codes[a], b, a)
    return at


class Suffixes:
    """The suffixes of a chunk that are at least a threshold long, with the least digit of each."""

    def __init__(self, table: pa.Table, threshold: int, digit: int):
        self.threshold = threshold
        self.texts = as_bytes(table["text"])
        data, self.starts = joined(self.texts)
        self.runs = Runs(BYTE_CODES[data])
        self.fits = np.flatnonzero(places_left(self.starts) > threshold)  # a space follows each text
        self.digits = self.runs.of(digit)
        width = threshold - digit + 1
        self.least = least(self.digits, width)[self.fits] if len(self.fits) else np.zeros(0, np.int32)

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each run of suffixes with the same least digit: that digit's code, and the code of all their windows together."""
        first = np.flatnonzero(np.diff(self.least, prepend=-1) != 0)
        last = np.r_[first[1:], len(self.least)] - 1 if len(first) else first
        return self.digits[self.least[first]], self.runs.between(self.fits[first], self.fits[last] + self.threshold).view(np.int64)


def _first_pass(n_buckets: int, threshold: int, digit: int):
    def send(key, table):
        s = Suffixes(table, threshold, digit)
        keys, stretches = s.stretches()
        order = np.lexsort((stretches, keys))
        keys, stretches = keys[order], stretches[order]
        first = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(stretches, prepend=~stretches[:1]) != 0))
        twice = np.diff(np.r_[first, len(keys)]) > 1
        return R.pack(key[0].as_py(), n_buckets, keys[first], twice, stretches[first])

    return send


def _last_pass(n_buckets: int, threshold: int, digit: int):
    def send(key, table, answers):
        s = Suffixes(table, threshold, digit)
        alive = s.fits[R.among(s.digits[s.least], R.answered(answers, R.OPEN))]
        keys, _, twice = R.distinct(s.runs.between(alive, alive + threshold))
        return R.pack(key[0].as_py(), n_buckets, keys, twice)

    return send


def _remove(threshold: int, digit: int):
    def remove(table, answers):
        s = Suffixes(table, threshold, digit)
        texts, starts = s.texts, s.starts
        digits = s.digits[s.least]
        yes = R.among(digits, R.answered(answers))
        rest = np.flatnonzero(R.among(digits, R.answered(answers, R.OPEN)))
        yes[rest] = R.among(s.runs.between(s.fits[rest], s.fits[rest] + threshold), R.answered(answers, AT_FULL_DEPTH))
        repeated = s.fits[yes]
        gone = covered(repeated, threshold, int(starts[-1]))
        edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_text": [], "kept_sha256": []}
        cuts = np.searchsorted(edges, starts).tolist()
        for i, t in enumerate(texts):
            own = (edges[cuts[i] : cuts[i + 1]] - starts[i]).tolist()
            spans = list(zip(own[0::2], own[1::2], strict=True))
            kept, at = [], 0
            for a, b in spans:
                kept.append(t[at:a])
                at = b
            kept = b"".join([*kept, t[at:]])
            out["n_bytes"].append(len(t))
            out["n_removed"].append(len(t) - len(kept))
            out["n_spans"].append(len(spans))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
            out["kept_text"].append(kept.decode(errors="ignore"))
            out["kept_sha256"].append(sha256(kept).hexdigest())
        kinds = {"spans": _SPANS, "kept_text": pa.string(), "kept_sha256": pa.string()}
        rest = {"rest": table["rest"]} if "rest" in table.column_names else {}
        return pa.table({"doc_id": table["doc_id"]} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()} | rest)

    return remove


def dedup_suffixes(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, carry: bool = False) -> DataFrame:
    """One row per document: its bytes, the removed spans, the kept text and the digest of the kept bytes.

    kept_text leaves out what remains of a character that a span cuts. With ``carry``, the struct ``rest``
    holds the columns of the document other than its text.
    """
    if not 0 < digit <= threshold:
        raise ValueError("a digit is at least one byte and at most the threshold")
    prepare(docs.sparkSession)
    chunks, n = R.chunked(docs, carry=[c for c in docs.columns if c != "text"] if carry else [])
    kind = T.StructType([*T.StructType.fromDDL(RESULT).fields, *chunks.schema.fields[3:]])
    first = R.ask(chunks.groupBy("chunk").applyInArrow(_first_pass(n, threshold, digit), R.SENT), R.split_further)
    last = R.ask(chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_last_pass(n, threshold, digit), R.SENT), R.repeated_anywhere)
    answers = first.unionByName(last.withColumn("kind", F.lit(AT_FULL_DEPTH)))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(threshold, digit), kind)
