from __future__ import annotations

import hashlib
import random
import re

import pytest

from plumbline.llm import exact


def brute(rows):
    groups = {}
    for at, (i, t, _) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), i, at))
    out = {}
    for key, members in groups.items():
        keep = min(members)
        for m in members:
            sha = hashlib.sha256(key.encode()).hexdigest()
            out[m[1]] = (keep[1], len(members), m == keep, sha)
    return out


@pytest.mark.parametrize("heavy", [1, 1000])
def test_matches_brute_force(spark, documents, heavy):
    rnd = random.Random(heavy)
    texts = ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randrange(5))) for _ in range(400)]
    texts += ["hot  copy"] * 150 + ["hot copy"] * 50
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    found = exact.exact_groups(documents(rows, 40), heavy=heavy).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == brute(rows)


def test_odd_rows(odd):
    found = exact.exact_groups(odd)
    assert found.count() == odd.count()
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    # one of the blank texts, one of the three equal ones, the long one, the last one
    assert kept.count() == 4
    assert {r["doc_id"] for r in kept.collect()} == {3, None, 5, 6}


def test_empty_table(documents):
    assert exact.exact_groups(documents([])).count() == 0


def test_frequent_items_are_proposed(spark, documents):
    df = documents(["hot"] * 300 + [f"cold {i}" for i in range(700)], 8)
    from pyspark.sql import functions as F

    marked = exact.digests(df)
    hot = marked.groupBy("sha").count().where("count > 100").select(F.xxhash64("sha")).first()[0]
    assert hot in {r.item for r in exact.frequent(marked, 64, 8).collect()}
