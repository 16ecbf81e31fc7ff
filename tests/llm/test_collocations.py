from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000, covered=50):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {lang: [] for lang in total}
    for (lang, words), a in frequent.items():
        held = max((v for (other, w), v in frequent.items() if other == lang and len(w) > len(words) and any(
            w[i : i + len(words)] == words for i in range(len(w)))), default=0)
        if 100 * held >= covered * a and held:
            continue
        cut = min((10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        l, r = f[lang, words[: cut[1]]], f[lang, words[cut[1] :]]
        out[lang].append((-cut[0], -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    )


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def corpus(seed=3, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = ["New", "york", "a", "b", "of", "THE", "é", "漢字", "x y", "the"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r", " ! "]
    for _ in range(n):
        size = int(rng.integers(0, 40))
        words = rng.choice(vocabulary, size, p=[.2, .2, .1, .1, .1, .1, .05, .05, .05, .05])
        between = rng.choice(gaps, size, p=[.6, .1, .1, .05, .05, .04, .03, .03])
        yield "".join(w + g for w, g in zip(words, between))


@pytest.mark.parametrize("sizes", [{}, {"mass": 500, "fan": 2, "bitmap": 12}])
def test_brute_force(spark, sizes):
    """Also with many hash partitions dealt in several rounds and a crowded bitmap."""
    rows = [(["en", "de", None][i % 3], text) for i, text in enumerate(corpus())]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert rows_of(C.collocations(df, **sizes)) == brute(rows)
    assert rows_of(C.collocations(df, longest=4, least=5, top=7, covered=80)) == brute(rows, 4, 5, 7, 80)


def test_odd_rows(spark, odd):
    rows = [("en", r[1]) for r in odd.collect()]
    assert rows_of(C.collocations(odd, least=2)) == brute(rows, least=2)
    assert C.collocations(odd.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    """The arithmetic of the score on counts that no small table has."""
    a = 90_000_000_000
    sql = (
        "(CAST(1000000 AS DECIMAL(7,0)) * CAST({0} AS DECIMAL(15,0)) * CAST({0} AS DECIMAL(15,0))) div"
        " (CAST({1} AS DECIMAL(19,0)) * CAST({2} AS DECIMAL(19,0)))"
    )
    l, r = a + 12345, 3 * a + 1
    found = spark.sql("SELECT " + sql.format(a, l, r) + " AS score").first()["score"]
    assert found == 10**6 * a * a // (l * r)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=8), st.integers(1, 12))
def test_summary_keeps_what_is_frequent(runs, least):
    everything = Counter(k for run in runs for k in run)
    summary = C.Summary(sum(everything.values()) // least + 1)
    for run in runs:
        keys, counts = np.unique(np.array(run, np.uint64), return_counts=True)
        summary.merge(keys, counts)
    assert len(summary.keys) <= summary.capacity and summary.lost < least
    assert {k for k, v in everything.items() if v >= least} <= set(summary.at_least(least).tolist())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 2**C.KEY - 1), st.integers(1, 10**12), min_size=1, max_size=50))
def test_runs_are_read_as_written(held):
    keys = np.array(sorted(held), np.uint64)
    counts = np.array([held[k] for k in sorted(held)], np.int64)
    again = C.read(len(keys), C.written(keys, counts))
    assert (again[0] == keys).all() and (again[1] == counts).all()
