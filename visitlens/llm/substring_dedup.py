"""Substring deduplication of word runs by difference-cover anchors.

A window is WINDOW consecutive words of one document. Its words are removed where the same
word sequence also starts earlier (smaller doc_id, or the same document further left).

Hashing every window would move one code a word. Instead only runs of WINDOW - PERIOD + 1 words
at *cover positions* are hashed: places whose index modulo PERIOD lies in COVER. COVER is a
difference cover, every residue is a difference of two of its members, so for any two equal windows there
is one shift below PERIOD that takes both starts to cover positions; both windows hold the run
there. A run that is found nowhere else rules out every window that needs it, and what is left is
extended to whole windows, whose first places the buckets compare.

Defined results: a null or empty text has no words and keeps none. Rows that share a doc_id and a
text count as the same place, so neither removes the other; rows that share a doc_id but not the
text are one document whose windows compete by start. A null doc_id comes before all others.
Columns beyond the two used are ignored. Keys are 64-bit codes.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats as R
from .common import Runs, as_bytes, covered, places_left, prepare, word_codes

WINDOW = 20
PERIOD = 13
#: The perfect difference set modulo 13.
COVER = (0, 1, 3, 9)
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _windows(table: pa.Table, window: int):
    """Texts, ids, and for each word place of a chunk: index in its document, whether a window fits, code of that window."""
    texts = as_bytes(table["text"])
    codes, starts = word_codes(texts)
    left = places_left(starts)
    index = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    ids = np.array([-(2**63) if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
    return texts, ids, Runs(codes), starts, left, index


def _anchor_places(index: np.ndarray, left: np.ndarray, run: int) -> np.ndarray:
    return np.flatnonzero(np.isin(index % PERIOD, COVER) & (left >= run))


def _send_anchors(n_buckets: int, window: int):
    run = window - PERIOD + 1

    def send(key, table):
        _, _, runs, _, left, index = _windows(table, window)
        at = _anchor_places(index, left, run)
        keys, _, twice = R.distinct(runs.of(run)[at] if len(at) else np.zeros(0, np.uint64))
        return R.pack(key[0].as_py(), n_buckets, keys, twice)

    return send


def _send_windows(n_buckets: int, window: int):
    run = window - PERIOD + 1

    def send(key, table, answers):
        _, ids, runs, starts, left, index = _windows(table, window)
        at = _anchor_places(index, left, run)
        if len(at):
            at = at[R.among(runs.of(run)[at], R.answered(answers))]
        near = np.zeros(len(left) + 1, np.int64)  # a window holds the anchor at p if it starts in (p - PERIOD, p]
        np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        places = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= window))
        keys = runs.of(window)[places] if len(places) else np.zeros(0, np.uint64)
        owner = np.repeat(ids, np.diff(starts))[places]
        order = np.lexsort((index[places], owner, keys))
        keys, owner, places = keys[order], owner[order], places[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        return R.pack(key[0].as_py(), n_buckets, keys[first], np.zeros(len(first)), owner[first], index[places[first]])

    return send


def _remove(window: int):
    def remove(table, answers):
        texts, ids, runs, starts, left, index = _windows(table, window)
        fits = np.flatnonzero(left >= window)
        keys = runs.of(window)[fits] if len(fits) else np.zeros(0, np.uint64)
        owner = np.repeat(ids, np.diff(starts))[fits]
        order = np.lexsort((index[fits], owner, keys))
        k, o, i = keys[order], owner[order], index[fits][order]
        new = np.diff(k, prepend=~k[:1]) != 0
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else order
        first = (o == o[head]) & (i == i[head])  # rows of the same document and text share a first place
        later = np.zeros(len(keys), bool)
        later[order] = ~first
        gone = covered(fits[later | R.among(keys, R.answered(answers))], window, len(left))
        out = {"doc_id": table["doc_id"], "n_words": [], "n_removed": [], "kept_text": [], "kept_sha256": []}
        for t, a, b in zip(texts, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            words = t.split()
            lost = int(gone[a:b].sum())
            kept = b" ".join(compress(words, (~gone[a:b]).tolist()) if lost else words)
            out["n_words"].append(b - a)
            out["n_removed"].append(lost)
            out["kept_text"].append(kept.decode())
            out["kept_sha256"].append(sha256(kept).hexdigest())
        return pa.table({c: v if c == "doc_id" else pa.array(v, pa.string() if c.startswith("kept") else pa.int64()) for c, v in out.items()})

    return remove


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, how many were removed, the kept words and their digest."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    prepare(docs.sparkSession)
    chunks, n = R.chunked(docs)
    anchors = R.ask(chunks.groupBy("chunk").applyInArrow(_send_anchors(n, window), R.SENT), R.repeated_anywhere)
    windows = R.ask(chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_send_windows(n, window), R.SENT), R.repeated_later)
    return chunks.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(_remove(window), RESULT)
