"""BPE encoding and decoding by a pair occurrence index.

Texts of a batch are cut at white space, and each distinct word is encoded once. All distinct
pieces of all words stand in one symbol array; an index maps the rank of each adjacent pair to all
places where the pair stands. Active ranks are taken in ascending order; all places of a rank merge
at once, and only the lists of the pairs to the left and right of a merge change.

Words can be encoded apart because no token of this kind of vocabulary reaches across white space:
its normalizer and its split pattern, which come from the vocabulary file, are applied to each.

Defined results: a null or empty text has no ids and decodes to an empty text. The strings of
special tokens in a text become those tokens, as in the library. Repeated rows each give a row.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, prepare, slices

RESULT = "doc_id long, n_tokens long, ids array<int>, decoded_text string, ids_sha256 string, decoded_sha256 string"
NONE = np.int32(2**31 - 1)
#: White space beyond ASCII, which the normalizer also turns into a space.
ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """A vocabulary file of the tokenizers library: BPE over byte characters with word ends, no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["end_of_word_suffix"] != "</w>" or spec["decoder"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a vocabulary of the kind this operator reads")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        vocab = model["vocab"]
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.size = len(self.strings)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        self.product = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self.twin = left == right
        made = {p: r for r, p in enumerate(self.product.tolist())}
        if len(made) < len(self.product) or any(made.get(x, -1) >= r for r, ab in enumerate(zip(left.tolist(), right.tolist(), strict=True)) for x in ab):
            raise ValueError("a merge stands before one that makes its parts: ranks can't be applied in batches")
        order = np.argsort(left * self.size + right)
        self.keys, self.ranks = (left * self.size + right)[order], order.astype(np.int32)
        single = [(ord(t), i) for t, i in vocab.items() if len(t) == 1]
        last = [(ord(t[0]), i) for t, i in vocab.items() if len(t) == 5 and t.endswith("</w>")]
        top = max(c for c, _ in single) + 1
        self.inner, self.last = np.full(top, -1, np.int32), np.full(top, -1, np.int32)
        for table, pairs in ((self.inner, single), (self.last, last)):
            for c, i in pairs:
                table[c] = i
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    # ---- words to pieces ------------------------------------------------------------------

    def pieces(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces; for all words in turn the piece numbers, and how many each word has.

        A special token is a piece whose first character is U+E000, which no byte stands for.
        """
        number: dict[str, int] = {}
        own: list[list[int] | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if not ODD.search(w)]
        for i in set(range(len(words))).difference(plain):
            own[i] = []
            for part in self.split_special.split(words[i]):
                found = ["\ue000" + part] if part in self.special else [p for p, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part))] if part else []
                own[i] += [number.setdefault(p, len(number)) for p in found]
        line = self.normalizer.normalize_str(" ".join(words[i] for i in plain)) if plain else ""
        cut = self.pre.pre_tokenize_str(line) if line else []
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        word = np.searchsorted(spaces, np.fromiter((a for _, (a, _) in cut), np.int64, len(cut)))
        numbers = np.fromiter((number.setdefault(p, len(number)) for p, _ in cut), np.int64, len(cut))
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.bincount(word, minlength=len(plain))
        if len(plain) < len(words):
            ends = np.cumsum(counts[plain])
            for i, a, b in zip(plain, ends - counts[plain], ends, strict=True):
                own[i] = numbers[a:b].tolist()
            counts = np.fromiter(map(len, own), np.int64, len(own))
            numbers = np.fromiter((x for o in own for x in o), np.int64, int(counts.sum()))
        return list(number), numbers, counts

    # ---- pieces to ids --------------------------------------------------------------------

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has."""
        special = [i for i, p in enumerate(pieces) if p[0] == "\ue000"]
        plain = ["!" if p[0] == "\ue000" else p for p in pieces]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        ends = np.cumsum(sizes)
        chars = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        n = len(chars)
        if not n:
            return np.zeros(0, np.int32), sizes
        symbol = self.inner[chars]
        symbol[ends - 1] = self.last[chars[ends - 1]]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def listed(places: np.ndarray) -> None:
            ranks = rank_at[places]
            places, ranks = places[ranks != NONE], ranks[ranks != NONE]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[[0, *cuts]].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        inner = np.flatnonzero(after >= 0)
        rank_at[inner] = self.rank(symbol[inner], symbol[inner + 1])
        listed(inner)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[rank_at[at] == r]
            if not len(at):
                continue
            if self.twin[r] and len(at) > 1:  # of a run of equal symbols, every other place
                head = np.r_[True, after[at[:-1]] != at[1:]]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbol[at] = self.product[r]
            alive[gone] = False
            rank_at[gone] = NONE
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            rank_at[at] = NONE
            ahead = before[at]
            left = at[has]
            touched = np.concatenate([left, ahead[ahead >= 0]])
            if len(touched):
                touched = np.unique(touched)
                rank_at[touched] = self.rank(symbol[touched], symbol[after[touched]])
                listed(touched)
        counts = np.add.reduceat(alive, ends - sizes, dtype=np.int64)
        ids = symbol[alive]
        if special:
            ids[(np.cumsum(counts) - 1)[special]] = [self.special[pieces[i][1:]] for i in special]
        return ids, counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in turn, and where each word's begin."""
        pieces, numbers, per_word = self.pieces(words)
        ids, counts = self.merge(pieces)
        flat, sizes = gathered(ids, np.r_[0, np.cumsum(counts)], numbers)
        ends = np.r_[0, np.cumsum(sizes)]
        return flat, ends[np.r_[0, np.cumsum(per_word)]]


def gathered(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``which`` of a sequence cut at ``starts``, one after another, and their sizes."""
    sizes = np.diff(starts)[which]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[which] - (ends - sizes), sizes)
    return values[np.arange(len(shift)) + shift], sizes


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(path: str, whole: bool):
    def encode(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            ids_of = batch.column("doc_id").cast(pa.int64())
            number: dict[bytes, int] = {}
            put = number.setdefault
            split = [np.fromiter((put(w, len(number)) for w in t.split()), np.int32) for t in texts]
            flat, starts = v.encode_words([w.decode() for w in number])
            cuts = starts.tolist()
            strings = [" ".join(map(v.strings.__getitem__, flat[a:b].tolist())).encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for a, b in slices(texts):
                out = {c: [] for c in ("n_tokens", "ids", "decoded_text", "ids_sha256", "decoded_sha256")}
                for words in split[a:b]:
                    ids = gathered(flat, starts, words)[0].astype("<u4")
                    text = b" ".join(filter(None, map(strings.__getitem__, words.tolist())))
                    out["n_tokens"].append(len(ids))
                    out["ids"].append(ids if whole else None)
                    out["decoded_text"].append(text.decode() if whole else None)
                    out["ids_sha256"].append(sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(sha256(text).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([ids_of[a:b], *(pa.array(x, kinds.get(c, pa.string())) for c, x in out.items())], names=["doc_id", *out])

    return encode


def encode_and_decode(docs: DataFrame, path: str | None = None, digests_only: bool = False) -> DataFrame:
    """One row per document: its ids, the decoded text and the digests of both.

    With ``digests_only``, ids and decoded_text are null: nothing larger than a digest leaves the task.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(path or default_vocabulary(), not digests_only), RESULT)
