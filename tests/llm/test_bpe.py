from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe
from plumbline.llm.queries import QUERIES

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(FILE, PATTERN)


@pytest.fixture(scope="module")
def pairs():
    return bpe.Pairs(bpe.vocabulary(FILE))


def lists(encoder, texts):
    ids, bounds = encoder(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_query_equals_the_library(spark, folder, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode_ordinary(texts[row.doc_id])
        written = " ".join(map(str, ids)).encode()
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(written).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_white_space_and_code_points(encoder, library):
    signs = [chr(c) for c in [*range(0x300), 0x1680, 0x180E, *range(0x2000, 0x2040), 0x3000, 0xFEFF, 0x1F600]]
    texts = [f"a{c}b {c}1{c}{c}  x{c} y {c}" for c in signs]
    texts += [" ", "  ", " a", "a ", "a  b", "\n a", "a \nb", "it's 'll", "a  b", "a  b"]
    assert lists(encoder, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(encoder, library, texts):
    assert lists(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_words(encoder, library):
    rng = random.Random(4)
    texts = ["ab" * 60_000, " " * 100_000, "".join(rng.choice("etaoin") for _ in range(60_000)), "x" * 65]
    assert lists(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_pairs_equal_merging(pairs):
    known, rng = pairs.known, random.Random(2)
    few = [t for t, data in known.tokens.items() if len(data) < 4]
    for _ in range(5000):
        a, b = rng.choice(few), rng.choice(few)
        data = known.tokens[a] + known.tokens[b]
        assert known.follows(b, a) == (merged(known, data) == [a, b])


def merged(known, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [known.ranks.get(a + b, known.never) for a, b in zip(parts, parts[1:])]
        if min(found) == known.never:
            break
        at = found.index(min(found))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [known.ranks[p] for p in parts]


letters = st.binary(max_size=200).map(lambda b: bytes(b"aeit nch "[x % 9] for x in b))


@settings(max_examples=100, deadline=None)
@given(letters, letters, st.integers(0, 200), st.integers(0, 9), letters)
def test_appends_and_edits(pairs, data, more, at, removed, inserted):
    prefix = bpe.Prefix(pairs, data)
    prefix.append(more)
    assert prefix.tokens() == merged(pairs.known, data + more)
    at = min(at, len(prefix.data))
    removed = min(removed, len(prefix.data) - at)
    whole = prefix.data[:at] + inserted + prefix.data[at + removed :]
    prefix.edit(at, removed, inserted)
    assert prefix.data == whole and prefix.last == bpe.Prefix(pairs, whole).last


def test_an_edit_works_out_few_prefixes(pairs):
    prefix = bpe.Prefix(pairs, b"the cat sat on the mat and " * 400)
    assert prefix.edit(3000, 2, b"zq") < 400


def test_odd_rows(spark, odd, library):
    found = bpe.decode(bpe.encode(odd, FILE, PATTERN), FILE).collect()
    texts = [r[1] or "" for r in odd.collect()]
    assert sorted((r.ids, bytes(r.bytes)) for r in found) == sorted(
        (library.encode_ordinary(t), t.encode()) for t in texts
    )
    assert bpe.digests(odd.limit(0), FILE, PATTERN).count() == 0


def test_ids_that_are_no_tokens(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r.bytes for r in bpe.decode(rows, FILE).orderBy("doc_id").collect()] == [None, b""]
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([(1, [50256])], "doc_id bigint, ids array<int>"), FILE).collect()
