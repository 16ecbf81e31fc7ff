from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import pii

# the patterns as they are stated, to compare with
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    spans = []
    for order, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                spans.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(spans)]


def test_base_spans_match_brute_force(documents):
    rnd = random.Random(3)
    parts = ["1", "2", "9", "0", "25", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "😀",
             "4539578763621486", "+1 (234) 555-1234", "192.168.1.1", "x@y.com", " call ",
             "555-123-4567", "joe (at) mail (dot) com", "\n", ", "]
    texts = [None, ""] + ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(600)]
    texts.append("a1@b.co " * 700 + "é" + " 1.2.3.4" * 600)
    found = {r.doc_id: r for r in pii.personal_data(documents(texts)).collect()}
    added = 0
    for i, text in enumerate(texts):
        spans, r = base(text), found[i]
        counts = [sum(s.startswith(k) for s in spans) for k in STATED]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(every)
        starts = [int(s.split(":")[1]) for s in every]
        assert starts == sorted(starts)
        added += len(every) - len(spans)
    assert added > 0


def test_method_adds_written_out_addresses(documents):
    texts = [f"please mail me at joe{i}@example.com now" for i in range(40)]
    texts += [f"please mail me: jane{i} (at) example (dot) org now" for i in range(10)]
    found = {r.doc_id: r.spans for r in pii.personal_data(documents(texts)).collect()}
    assert all(found[i].startswith("email:16:") for i in range(40, 50))


def test_reliabilities_tell_good_labelers_from_bad():
    strict, listed, glued = 1, 2, 16
    counts = {(0, strict | listed): 900, (0, 0): 80, (0, glued): 60, (0, listed): 50}
    likely, table = pii.reliabilities(counts)
    assert likely[0, strict | listed] > 0.9 > 0.5 > likely[0, 0]
    assert table[0][1, 1] > table[0][0, 1]
    weights = pii.trained(counts, likely)
    assert weights[len(pii.KINDS)] > 0


def test_odd_rows(odd, documents):
    found = pii.personal_data(odd)
    assert found.count() == odd.count()
    assert {r.spans for r in found.collect()} == {""}
    assert pii.personal_data(documents([])).count() == 0


PLAIN = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "IP": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
}


@pytest.mark.parametrize("name", PLAIN)
def test_patterns_find_what_the_plain_ones_find(spark, name):
    """Python's matches of the stated pattern, on random texts of its characters."""
    rng = random.Random(8)
    signs = "ab1@..-_ 2" if name == "EMAIL" else "12.. a"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", pii.located(F.col("t"), getattr(pii, name)).alias("s")).collect()
    for row in found:
        plain = [(m.start(), m.end(), m.group()) for m in re.finditer(PLAIN[name], row.t)]
        assert [tuple(s) for s in row.s or []] == plain


def test_long_runs(documents):
    texts = ["x@a" + ".a" * 50_000, "@" + "x" * 100_000, "1" * 100_000, "1." * 50_000, "a (at) b" + " . c" * 25_000]
    found = {r.doc_id: (r.n_email, r.n_ip, r.n_card) for r in pii.personal_data(documents(texts)).collect()}
    assert found == {0: (1, 0, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 12_500, 0), 4: (0, 0, 0)}
