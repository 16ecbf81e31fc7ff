from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffixes as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = {}
    for d, t in enumerate(data):
        for p in range(len(t) - length + 1):
            starts.setdefault(t[p : p + length], []).append((d, p))
    gone = [bytearray(len(t)) for t in data]
    for found in starts.values():
        if len(found) > 1:
            for d, p in found:
                gone[d][p : p + length] = b"\1" * length
    out = []
    for t, g in zip(data, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, count):
    rnd = random.Random(seed)
    alphabet = "abcdefgh\n é"
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(100, 1600))) for _ in range(8)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rnd.randrange(5)):
            kind = rnd.random()
            if kind < 0.5:
                p = rnd.choice(passages)
                at = rnd.randrange(len(p))
                parts.append(p[at : at + rnd.randrange(1, 1200)])
            elif kind < 0.65:
                parts.append(rnd.choice(["ab", "a", "xyz", "é"]) * rnd.randrange(1, 500))
            else:
                parts.append("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 400))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 6)])
def test_matches_brute_force(documents, seed, parts):
    texts = corpus(seed, 60) + ["same " * 300] * 3
    found = S.without_repeats(documents(texts, parts)).collect()
    want = brute(texts, S.LENGTH)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(enumerate(want))


def test_odd_rows(odd, documents):
    found = {r.doc_id: r for r in S.without_repeats(odd).collect()}
    assert (found[1].n_bytes, found[3].n_bytes) == (0, 3)
    # 'word ' over and over repeats itself, end to end
    assert (found[5].n_removed, found[5].n_spans) == (150_000, 1)
    assert S.without_repeats(documents([])).count() == 0


def test_levels_find_repeats_and_stay_few():
    rnd = np.random.default_rng(1)
    levels, seen = S.Levels(), {}
    for _ in range(200):
        keys = rnd.integers(0, 5000, 40, dtype=np.uint64)
        tags = rnd.integers(0, 2, 40, dtype=np.uint32)
        for pair in zip(keys.tolist(), tags.tolist()):
            seen[pair] = seen.get(pair, 0) + 1
        levels.add(*S.once(*S.ordered(keys, tags)))
    keys, tags = levels.repeated()
    assert set(zip(keys.tolist(), tags.tolist())) == {p for p, n in seen.items() if n > 1}
    assert len(levels.levels) <= 12


def test_slices_change_nothing(monkeypatch):
    texts = [t.encode() for t in corpus(5, 40)]
    data = np.frombuffer(b"".join(texts), "u1")
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = S.Scan(data, bounds)
    monkeypatch.setattr(S, "SLICE", 777)
    parts = S.Scan(data, bounds)
    assert set(whole.grams.tolist()) == set(parts.grams.tolist())
    assert set(whole.block_keys.tolist()) == set(parts.block_keys.tolist())
