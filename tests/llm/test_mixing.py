from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.ranks import numbered


def level(sizes, weights, share, most):
    """Targets by handing out the excess until none is above."""
    total, caps = share * sum(sizes), [most * s for s in sizes]
    full = [False] * len(sizes)
    while True:
        left = total - sum(c for c, f in zip(caps, full) if f)
        whole = sum(w for w, f in zip(weights, full) if not f)
        now = [c if f else left * w / whole for c, w, f in zip(caps, weights, full)]
        above = [not f and n > c for n, c, f in zip(now, caps, full)]
        if not any(above):
            return now
        full = [f or a for f, a in zip(full, above)]


def test_targets_and_taken(spark, documents):
    rnd = random.Random(2)
    rows = [
        (i, " ".join("w" * (1 + k % 3) for k in range(rnd.choice([1, 3, 30, 200]))),
         rnd.choice(["a"] * 8 + ["b", "c", "d", None]))
        for i in range(600)
    ]
    found = mixing.mix(documents(rows, 5)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(s for s in sizes if s is not None) + [None]
    targets = level([sizes[s] for s in order], [3, 1, 2, 3, 1][: len(order)], 1.5, 2)
    for s, target in zip(order, targets):
        own = [r for r in found if r.source == s]
        assert own[0].target == pytest.approx(target)
        assert own[0].source_size == sizes[s]
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own)
    assert sum(targets) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(documents):
    rows = [(i, "x " * (i % 17), f"s{i % 4}") for i in range(300)]
    one, two = (
        {(r.doc_id, r.taken) for r in mixing.mix(documents(rows, p)).collect()} for p in (1, 7)
    )
    assert one == two


def test_odd_rows(odd):
    found = mixing.mix(odd)
    assert found.count() == odd.count()
    assert found.where("size = 0 AND taken <> 0").count() == 0
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == found.agg(F.sum("copies")).first()[0]


def test_empty_and_wordless(documents):
    assert mixing.mix(documents([])).count() == 0
    found = mixing.mix(documents(["", None, " "])).collect()
    assert [(r.target, r.taken) for r in found] == [(0.0, 0)] * 3


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert numbered(df, F.asc("v")).where("v <> __at").count() == 0
