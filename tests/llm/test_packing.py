from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(FILE)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(
    alphabet="aB cÉß'sİ1²,.!<|endoftext>\n\t\x1c\x85\xa0ﬁΣσ́", max_size=40))
def test_words_are_encoded_like_whole_texts(text):
    encoder = packing.encoder(FILE)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(text), "<u4").tolist() == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_windows_hold_everything_once(sizes):
    windows = packing.packed(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows)


def test_differencing_is_near_equal():
    rnd = random.Random(1)
    sizes = [c for _ in range(300) for c in packing.cuts(rnd.randrange(1, 4096), rnd.random() < 0.2)]
    sums = [sum(sizes[i] for i in w) for w in packing.differenced(sizes, 60)]
    assert max(sums) - min(sums) <= 8


def test_known_case():
    # the classic two-way example: differencing leaves a spread of 2
    windows = packing.differenced([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in windows) == [14, 16]


def check(pieces, texts, encoder, window=4096):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, text in texts.items():
        ids = encoder(text) + np.array([2], "<u4").tobytes()
        at = 0
        for p in sorted(docs[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids) // 4)
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sequences


def test_round_trip(spark, documents, encoder):
    rnd = random.Random(4)
    texts = {i: " ".join("word"[: rnd.randrange(1, 5)] + str(rnd.randrange(99)) for _ in range(
        rnd.choice([0, 1, 50, 400, 5000]))) for i in range(120)}
    pieces = packing.pack(documents([(i, t, "s") for i, t in texts.items()], 2), FILE).collect()
    sequences = check(pieces, texts, encoder)
    tokens = sum(p.length for p in pieces)
    assert 1 - tokens / (4096 * len(sequences)) < 0.03


def test_odd_rows(odd, documents, encoder):
    pieces = packing.pack(odd, FILE).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, None, 4, 5, 6}
    assert [p.doc_tokens for p in pieces if p.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack(documents([]), FILE).count() == 0
