from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import fingerprints as P


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in (a, b))
    joint = sum((a | b).values())
    return sum((a & b).values()) / joint if joint else 1.0


@pytest.mark.parametrize("shard", [3000, 1 << 20])
def test_estimates_generalised_jaccard(documents, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD", shard)
    rnd = random.Random(6)
    common = [f"w{i}" for i in range(40)]
    texts = [
        " ".join(rnd.choice(common) + rnd.choice(["", "é"]) for _ in range(rnd.choice([1, 5, 60, 200])))
        for _ in range(150)
    ]
    texts[70] = texts[71] = texts[3]
    found = {r.doc_id: r for r in P.fingerprints(documents(texts, 4)).collect()}
    assert len(found) == len(texts)
    errors = []
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.02
    assert np.sqrt((errors**2).mean()) < 0.075  # 1 / (2 sqrt(64)), and some room
    assert found[70].fingerprint == found[71].fingerprint == found[3].fingerprint
    assert found[70].near_next == 1.0


def test_odd_rows(odd, documents):
    found = P.fingerprints(odd).collect()
    assert len(found) == odd.count()
    empty = [r for r in found if r.doc_id in (1, 2, 3)]
    assert {r.fingerprint for r in empty} == {""}
    # NULL ids come first: after the empty text 1 comes the empty text 2
    assert {(r.doc_id, r.near_next) for r in empty} >= {(1, 1.0), (2, 1.0), (3, 0.0)}
    alone = P.fingerprints(documents(["only one"])).first()
    assert alone.near_next == 1.0
    assert P.fingerprints(documents([])).count() == 0


def test_limits_change_nothing(documents, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randint(0, 300)}" for _ in range(rnd.choice([0, 3, 90, 900]))) for _ in range(60)]
    texts[7] = " ".join(["same"] * 700)
    monkeypatch.setattr(P, "SHARD", 4000)
    found = []
    for reach in (0.05, 3.0, 16.0, 1e9):  # nothing found, many texts worked out again, few, no limit
        monkeypatch.setattr(P, "REACH", reach)
        found.append(sorted(map(tuple, P.fingerprints(documents(texts, 3)).collect())))
    assert found[0] == found[1] == found[2] == found[3]
    assert len(found[0]) == len(texts)


def test_terms_are_sampled_without_lists_of_texts(documents):
    docs = documents(["a b c", "a b d"]).selectExpr(
        "0L AS shard", "doc_id AS ord", "'x' AS fact", "text", "left(text, 2) AS kept", "text AS edited"
    )
    plan = P.signatures(docs, reach=P.REACH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # the samples of a text, not the texts of a term


@pytest.mark.parametrize("reach", [3.0, 16.0])
def test_edited_texts_have_the_fingerprint_of_their_words(documents, monkeypatch, reach):
    monkeypatch.setattr(P, "REACH", reach)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aé𝄞\u00a0z") for _ in range(rnd.choice([1, 2, 9])))
    texts = ["".join(word() + rnd.choice([" ", "\n", "\t ", "  "]) for _ in range(n)) for n in (0, 1, 2, 3, 8, 40, 90)]
    texts += ["unbroken" * 40, " lead", "   ", "same " * 30, None]
    whole = [t or "" for t in texts]
    edited = [
        t[: len(t) - len(t) // 2] + whole[(i + 1) % len(whole)][: len(t) // 2] for i, t in enumerate(whole)
    ]
    found = {r.doc_id: r for r in P.fingerprints(documents(texts, 3)).collect()}
    again = {r.doc_id: r for r in P.fingerprints(documents(edited, 2)).collect()}
    for i in range(len(texts)):
        assert found[i].edited_fingerprint == again[i].fingerprint
