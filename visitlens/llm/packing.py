"""Packing token sequences by first-fit decreasing in randomised groups.

A document is cut into pieces of the capacity and a rest. Pieces are dealt at random (by a hash of the piece and of its
place in the table) into groups of about GROUP pieces; a group is one task's work, and the number of groups follows the
number of pieces, as the texts' bytes give it. In a group, pieces are placed by descending length, each in the first sequence
with room, which a tournament tree of free capacities finds in logarithmic time.

Defined results: a null text is empty and packs its end id alone. Rows that repeat a doc_id are
packed as documents of their own. No id is dropped or held twice. An empty table packs to no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ODD, default_vocabulary
from .common import BYTE_CODES, IS_SPACE, Runs, as_bytes, joined, prepare, slices

CAPACITY = 4096
END_ID = 2
GROUP = 2048
TOKEN_BYTES = 4
#: Words that a worker remembers in each of two generations, some 30 bytes each; and bytes of text that it works on at once.
CACHED_WORDS, SLICE = 600_000, 1 << 20
#: Letters of Latin scripts that stay one letter in lower case and in composed form.
LETTER = re.compile("[A-Za-z\u00b5\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
#: Lines of one word each: letters and what may follow them, or anything else; and what only the whole library encodes.
FORM = re.compile(rf"(?:((?:{LETTER.pattern})+)([,.]?)|([^\n]+))\n")
ODD_WORD = re.compile(rf"\x00|{ODD.pattern}")
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


# ---- tokens -------------------------------------------------------------------------------


class Words:
    """Ids of words by the 64-bit code of a word: sorted codes, and where each one's ids stand."""

    def __init__(self):
        self.codes, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def add(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(codes)
        at = np.searchsorted(self.codes, codes[order])
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.codes, self.starts, self.sizes = (np.insert(x, at, y[order]) for x, y in ((self.codes, codes), (self.starts, starts), (self.sizes, sizes)))
        self.ids = np.concatenate([self.ids, ids])

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these places has, and all ids in turn."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        return sizes, self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """The tokenizers library, not asked for words among the last CACHED_WORDS used (and up to as many before them).

    Words are told apart by 64-bit codes: two of a million remembered ones share a code with a probability of about 3e-8.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark_id, *more = self._ids(["\x00"])[0]
        if more:
            raise ValueError("the vocabulary has no single token for a zero byte")
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known, self.before = Words(), Words()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words. The normalizer folds case, and a comma or full stop after a letter is a piece of its own: so fewer are asked for.

        That is so only where the letter still ends the word once it is normalized; the dotted capital I ends in a mark, for one.
        """
        forms = FORM.findall(b"\n".join([*words, b""]).lower().decode())
        odd = [w for w, (_, _, other) in zip(words, forms, strict=True) if other and ODD_WORD.search(other)]
        asked = dict.fromkeys(stem for stem, _, _ in forms if stem)
        # a word of letters is one piece, so its last token is its only one that ends a word; other words need a mark between them
        self._ask(list(asked), " ", asked)
        self._ask(list({x for _, tail, other in forms for x in (tail, other) if x and not ODD_WORD.search(x)}), " \x00 ", asked)
        asked[""] = b""
        whole = {w: np.array(ids, "<u4").tobytes() for w, ids in zip(odd, self._ids([w.decode() for w in odd]), strict=True)}
        return [whole[w] if w in whole else asked[stem] + asked[tail] if stem else asked[other] for w, (stem, tail, other) in zip(words, forms, strict=True)]

    def _ask(self, words: list[str], between: str, asked: dict) -> None:
        lines = [words[i : i + 256] for i in range(0, len(words), 256)]
        for line, ids in zip(lines, self._ids([between.join(line) for line in lines]), strict=True):
            ids = np.array(ids, "<u4")
            data = ids.tobytes()
            if between == " ":
                ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
                starts = [0, *ends[:-1]]
            else:
                marks = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
                starts, ends = [0, *(m + 4 for m in marks)], [*marks, len(data)]
            for text, a, b in zip(line, starts, ends, strict=True):
                asked[text] = data[a:b]

    def remember(self, codes: np.ndarray, words) -> None:
        """Make the distinct codes known; words gives the words of some of them."""
        new = np.flatnonzero(self.known.find(codes) < 0)
        if len(self.known.codes) + len(new) > CACHED_WORDS:
            self.known, self.before = Words(), self.known
            new = np.arange(len(codes))
        old = self.before.find(codes[new])
        self.known.add(codes[new[old >= 0]], *self.before.of(old[old >= 0]))
        new = new[old < 0]
        if len(new):
            found = self.learn(words(new))
            sizes = np.array([len(x) // 4 for x in found], np.int32)
            self.known.add(codes[new], sizes, np.frombuffer(b"".join(found), "<u4"))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        data, starts = joined(texts)
        edge = np.flatnonzero(np.diff(IS_SPACE[data].view(np.int8), prepend=1))
        first, last = edge[0::2], edge[1::2]
        if not len(first):
            return [b""] * len(texts)
        codes, where, which = np.unique(Runs(BYTE_CODES[data]).between(first, last), return_index=True, return_inverse=True)
        self.remember(codes, lambda new: [data[a:b].tobytes() for a, b in zip(first[where[new]].tolist(), last[where[new]].tolist(), strict=True)])
        sizes, ids = self.known.of(self.known.find(codes)[which])
        ends = np.r_[0, 4 * np.cumsum(sizes, dtype=np.int64)][np.searchsorted(first, starts)].tolist()
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_whole(self, text: bytes) -> bytes:
        """One text, by parts that end at a space where it is long."""
        parts, at = [], 0
        while at < len(text):
            end = text.find(b" ", at + SLICE)
            end = len(text) if end < 0 else end
            parts += self.encode([text[at:end]])
            at = end
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        e = encoder(path)
        for batch in batches:
            texts, names = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, SLICE):
                out = {c: [] for c in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens")}
                found = e.encode(texts[a:b]) if b - a > 1 else [e.encode_whole(texts[a])]
                for name, ids in zip(names[a:b], found, strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        for c, x in zip(out, (name, at // 4, len(piece) // 4, piece, zlib.crc32(piece), len(ids) // 4), strict=True):
                            out[c].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in out.items()], names=list(out))

    return cut


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and its end id, cut at the capacity: one row per piece (ids as little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path or default_vocabulary(), capacity, end_id), PIECES)


# ---- packing ------------------------------------------------------------------------------


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin and its offset there."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [capacity] * (2 * leaves)  # a node holds the most room among the bins below it
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def _place(capacity: int):
    def place(key, table):
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        ids = (np.int64(key[0].as_py()) << np.int64(32)) + bins
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return place


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY, seed: int = 17) -> DataFrame:
    """The pieces with sequence_id and offset; every piece has a length of 1 to the capacity."""
    prepare(pieces.sparkSession)
    # the row's number keeps apart pieces of repeated rows, and of rows without an id
    code = F.xxhash64("doc_id", "start", F.monotonically_increasing_id(), F.lit(seed))
    dealt = pieces.withColumn("pack_group", F.pmod(code, F.lit(groups)))
    kind = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("pack_group").applyInArrow(_place(capacity), kind)


def groups_for(docs: DataFrame, capacity: int = CAPACITY) -> int:
    """So many groups that each gets about GROUP pieces."""
    pieces = docs.agg(F.sum(F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / (TOKEN_BYTES * capacity)))).first()[0] or 0
    return max(1, -(-int(pieces) // GROUP))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack: one row per piece, with its ids if they are asked for."""
    pieces = token_pieces(docs, path, capacity, end_id)
    return pack(pieces if with_ids else pieces.drop("ids"), groups_for(docs, capacity), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids, padded to the capacity unless their number is a power of two."""

    def fill(key, table):
        order = np.argsort(table["offset"].to_numpy())
        ids = table["ids"].to_pylist()
        row = np.frombuffer(b"".join(ids[i] for i in order), "<u4").astype(np.int32)
        used = len(row)
        if used & (used - 1):
            row = np.pad(row, (0, capacity - used), constant_values=pad_id)
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([used], pa.int64()), "ids": pa.array([row], pa.list_(pa.int32()))})

    return packed.groupBy("sequence_id").applyInArrow(fill, "sequence_id long, n_tokens long, ids array<int>")
