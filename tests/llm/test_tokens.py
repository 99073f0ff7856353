import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import corpora
from visitlens.llm import bpe, packing

PATH = bpe.default_vocabulary()
HARD = ["aaaa aaaaaaaaaaaa", "<|endoftext|>x<|startoftext|> <|endoftext|>", "a b\x85c\xa0", " ", "é ́ Å", "ΑΣ ΣΑΣ İI", "don't we'll 're", "𝒳🎉 1٣४", "<| <|end", "\x1c\x1d x\x1fy", "ﬁ Ａ ①"]


@lru_cache(1)
def library():
    return Tokenizer.from_file(PATH)


def library_ids(text):
    return library().encode(text, add_special_tokens=False).ids


def test_encode_and_decode_match_the_library(spark):
    data = corpora.rows() + [(2000 + i, t, None, None, None) for i, t in enumerate(HARD)]
    rows = bpe.encode_and_decode(corpora.frame(spark, data)).collect()
    assert len(rows) == len(data)
    texts = {d: t or "" for d, t, *_ in data}
    for r in rows:
        ids = library().encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids, texts[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.decoded_text == library().decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(r.decoded_text.encode()).hexdigest()
    assert bpe.encode_and_decode(corpora.frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters=" \t\n\r\x0b\x0c"), min_size=1, max_size=12), min_size=1, max_size=8, unique=True))
def test_words_match_the_library(words):
    flat, starts = bpe.vocabulary(PATH).encode_words(words)
    for w, a, b in zip(words, starts, starts[1:]):
        assert flat[a:b].tolist() == library_ids(w)


TRICKY = st.text(alphabet=st.sampled_from("aZéİıßǅſΣς\u0301\u0307\u0958ﬁ١.,'’-<|>\x85\xa0\x00🎉"), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.builds(str.__add__, TRICKY, st.sampled_from(["", ",", ".", "..", ",."])), min_size=1, max_size=8, unique=True))
def test_the_packing_encoder_matches_the_library(words):
    encoder = packing.encoder(PATH)
    for w, ids in zip(words, encoder.encode([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(w)


def test_the_encoder_forgets_no_word_in_use(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder = packing.Encoder(PATH)
    for i in range(12):
        text = f"often w{i} x{i} y{i}, often"
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == library_ids(text)
        assert len(encoder.known.codes) <= 5 and len(encoder.before.codes) <= 5


def test_long_texts_are_encoded_by_parts():
    text = (" \n".join(f"word{i % 700} w{i}," for i in range(70_000)) + "  end ").encode()
    encoder = packing.encoder(PATH)
    assert len(text) > packing.SLICE and encoder.encode_whole(text) == encoder.encode([text])[0] == np.array(library_ids(text.decode()), "<u4").tobytes()
    assert encoder.encode([b"", b" ", b"a", b""]) == [b"", b"", encoder.encode([b"a"])[0], b""] and encoder.encode_whole(b"") == b""


def check_packing(rows, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 4096
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*library_ids(text), 2], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_packing(spark):
    data = corpora.rows() + [(2000 + i, t, None, None, None) for i, t in enumerate(HARD)]
    docs = corpora.frame(spark, data)
    packed = packing.pack_documents(docs)
    rows = packed.collect()
    check_packing(rows, {d: t or "" for d, t, *_ in data})
    full = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in full) == sum(r.length for r in rows)
    assert all(len(r.ids) == 4096 or len(r.ids) & (len(r.ids) - 1) == 0 for r in full)
    assert packing.pack_documents(corpora.frame(spark, [])).count() == 0


def test_packing_pads_little_and_deals_repeated_rows_apart(spark):
    r = np.random.default_rng(8)
    data = [(i, " ".join(["the"] * int(n)), None, None, None) for i, n in enumerate(np.minimum(r.lognormal(5.5, 1.2, 3000).astype(int), 30000))]
    rows = packing.pack_documents(corpora.frame(spark, data)).collect()
    used = defaultdict(int)
    for x in rows:
        used[x.sequence_id] += x.length
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values())
    assert padding < 0.01 * sum(used.values()) and sum(used.values()) == sum(len(t.split()) + 1 for _, t, *_ in data)
    same = packing.pack(packing.token_pieces(corpora.frame(spark, [(None, "same text", None, None, None)] * 400)), 8)
    assert len({x.sequence_id >> 32 for x in same.collect()}) == 8


def test_packing_edges(spark):
    long = "word " * 400_000
    data = [(None, "a b", None, None, None), (None, "c", None, None, None), (3, "x", None, None, None), (3, "x", None, None, None), (4, None, None, None, None), (5, long, None, None, None)]
    docs = corpora.frame(spark, data).selectExpr("*", "1 as pack_group", "2 as start", "3 as ids", "4 as sequence_id")
    rows = packing.pack_documents(docs).collect()
    assert sorted(r.doc_tokens for r in rows if r.doc_id is None) == [2, 3] and [r.doc_tokens for r in rows if r.doc_id == 3] == [2, 2]
    assert [r.length for r in rows if r.doc_id == 4] == [1]
    check_packing([r for r in rows if r.doc_id == 5], {5: long})
    assert packing.groups_for(docs) == 1 and packing.groups_for(docs, capacity=64) == 4


def test_first_fit_decreasing_is_first_fit():
    lengths = np.random.default_rng(3).integers(1, 4097, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 4096)
    used = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, u in enumerate(used) if u + lengths[i] <= 4096), len(used))
        if b == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += lengths[i]


def test_a_vocabulary_of_another_kind_is_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
