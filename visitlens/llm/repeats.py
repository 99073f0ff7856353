"""Finding equal keys across a corpus without sending any key twice from one place.

Documents are dealt into chunks of a few MB by a hash of id and text, so rows without an id spread like others. A chunk sends each of its
*distinct* keys once, packed with the others of the same bucket, and each bucket answers every
chunk which of its keys are repeated. A key that a third of all documents hold therefore costs
one entry a chunk, never one a document, and neither side holds more than a chunk or a bucket.
Chunks follow from the rows alone, so a task that is run again makes the same ones. The numbers of chunks and of buckets
follow the bytes of the texts, so either stays a few MB at any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

CHUNK_BYTES, CHUNKS_A_BUCKET = 2 << 20, 4
SENT = "bucket int, chunk long, keys binary, flags binary, ids binary, places binary"
ANSWER = "chunk long, kind int, keys binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary())])
#: What an answer says of its keys: their places are decided, or they have to be looked at further.
DECIDED, OPEN = 0, 1
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("keys", "flags", "ids", "places")])


def chunked(docs: DataFrame, carry: list[str] = ()) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text), and a struct of further columns if there are any, in as many chunks as the texts need at CHUNK_BYTES each; and how many buckets serve them."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // CHUNK_BYTES))
    rest = [F.struct(*carry).alias("rest")] if carry else []
    chunks = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)
    return chunks, max(partitions(docs.sparkSession), -(-n // CHUNKS_A_BUCKET))


def pack(chunk: int, n_buckets: int, keys: np.ndarray, flags: np.ndarray, ids: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.Table:
    """Rows for the buckets: the sorted distinct keys of a chunk, with flags (1: more than once here) and first places."""
    if not len(keys):
        return _SENT.empty_table()
    bucket = (keys >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(2**63)))
    ends = [*cuts[1:], len(order)]
    rows = {c: [] for c in _SENT.names}
    for a, b in zip(cuts.tolist(), ends, strict=True):
        at = order[a:b]
        rows["bucket"].append(int(bucket[at[0]]))
        rows["chunk"].append(chunk)
        rows["keys"].append(keys[at].tobytes())
        rows["flags"].append(flags[at].astype(np.uint8).tobytes())
        rows["ids"].append(b"" if ids is None else ids[at].astype(np.int64).tobytes())
        rows["places"].append(b"" if places is None else places[at].astype(np.int32).tobytes())
    return pa.table(rows, schema=_SENT)


def repeated_anywhere(table: pa.Table) -> pa.Table:
    """Of one bucket: the keys that several chunks hold, or one chunk more than once."""
    keys, flags, _, _ = _columns(table)
    _, which = np.unique(keys, return_inverse=True)
    return _answer(table, {DECIDED: np.bincount(which, weights=flags + 1.0)[which] >= 2})


def repeated_later(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the keys whose first place there isn't the first of all, nor the same place of a row that shares its id."""
    keys, _, ids, places = _columns(table)
    order = np.lexsort((places, ids, keys))
    k, i, p = keys[order], ids[order], places[order]
    head = np.maximum.accumulate(np.where(np.diff(k, prepend=~k[:1]) != 0, np.arange(len(k)), 0)) if len(k) else order
    later = np.empty(len(keys), bool)
    later[order] = (i != i[head]) | (p != p[head])
    return _answer(table, {DECIDED: later})


def split_further(table: pa.Table) -> pa.Table:
    """Of one bucket, where ids say what a key stands in: keys found again are decided if all stand in the same, else open."""
    keys, flags, ids, _ = _columns(table)
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    head = np.diff(k, prepend=~k[:1]) != 0
    which = np.cumsum(head) - 1
    kinds = np.bincount(which, weights=head | (np.diff(i, prepend=~i[:1]) != 0))
    total = np.bincount(which, weights=flags[order] + 1.0)
    decided, open_ = np.empty(len(keys), bool), np.empty(len(keys), bool)
    decided[order] = ((total >= 2) & (kinds == 1))[which]
    open_[order] = (kinds > 1)[which]
    return _answer(table, {DECIDED: decided, OPEN: open_})


def _columns(table: pa.Table) -> list[np.ndarray]:
    kinds = (("keys", np.uint64), ("flags", np.uint8), ("ids", np.int64), ("places", np.int32))
    return [np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in kinds]


def _answer(table: pa.Table, said: dict[int, np.ndarray]) -> pa.Table:
    out, at = {c: [] for c in _ANSWER.names}, 0
    for chunk, part in zip(table["chunk"].to_pylist(), table["keys"].to_pylist(), strict=True):
        part = np.frombuffer(part, np.uint64)
        for kind, yes in said.items():
            found = part[yes[at : at + len(part)]]
            if len(found):
                for c, x in zip(out, (chunk, kind, found.tobytes()), strict=True):
                    out[c].append(x)
        at += len(part)
    return pa.table(out, schema=_ANSWER)


def ask(sent: DataFrame, judge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Deal what the chunks sent to the buckets; the answers, by chunk."""
    return sent.groupBy("bucket").applyInArrow(judge, ANSWER)


def answered(answers: pa.Table, kind: int = DECIDED) -> np.ndarray:
    """The keys of one chunk that the buckets named, sorted."""
    rows = zip(answers["kind"].to_pylist(), answers["keys"].to_pylist(), strict=True)
    return np.sort(np.frombuffer(b"".join(keys for k, keys in rows if k == kind), np.uint64))


def among(keys: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``named``; most are ruled out by 16 of their bits."""
    hit = np.zeros(len(keys), bool)
    if len(named):
        seen = np.zeros(1 << 16, bool)
        seen[(named & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(named, keys[maybe])
        hit[maybe] = named[np.minimum(at, len(named) - 1)] == keys[maybe]
    return hit


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first index of each, and whether it stands more than once."""
    found, first, count = np.unique(keys, return_index=True, return_counts=True)
    return found, first, count > 1
