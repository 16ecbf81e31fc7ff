from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components as C
from plumbline.llm import ngram_join as N
from plumbline.llm import words as W
from plumbline.llm.components import components
from plumbline.sources.pinning import pin


def sets(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    found = re.findall(rb"[^\x20\x09-\x0d]+", lowered)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute(rows):
    """doc -> (shingles, smallest id reachable), by counting all shared shingles."""
    own, parent = [sets(t) for _, t, _ in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, found in enumerate(own):
        for g in found:
            holders.setdefault(g, []).append(i)
    for i, found in enumerate(own):
        for j, n in Counter(j for g in found for j in holders[g] if j > i).items():
            if 100 * n >= 75 * (len(found) + len(own[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(own[i]), low[root(i)]) for i, (d, _, _) in enumerate(rows)}


def corpus(seed, count, bases, edits, quoted):
    rnd = random.Random(seed)
    texts = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([2, 5, 8, 12, 20, 40, 100, 300]))]
             for _ in range(bases)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(count):
        own = list(rnd.choice(texts))
        for _ in range(rnd.randrange(1 + max(1, int(len(own) * edits)))):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        if rnd.random() < quoted:
            k = rnd.randrange(len(own) + 1)
            own[k:k] = passage
        rows.append((i, " ".join(own), "s"))
    return rows


@pytest.mark.parametrize(
    "count, bases, edits, quoted, hot", [(700, 250, 0.06, 0.5, 3), (600, 4, 0.06, 0.1, 200)]
)
def test_matches_brute_force(documents, count, bases, edits, quoted, hot):
    rows = corpus(count, count, bases, edits, quoted)
    found = N.linked(documents(rows, 5), hot=hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_odd_rows(odd, documents):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in N.linked(odd).collect()}
    assert found == {
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, 4), (4, 1, 4), (5, 1, 5), (6, 3, 6)
    }
    kept = N.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    assert N.linked(documents([])).count() == 0


def test_bands_reach_every_possible_partner():
    starts = N.band_starts(3000)
    band = np.searchsorted(starts, np.arange(3001), side="right") - 1
    for size in range(1, 3001):
        least = -(-3 * size // 4)
        assert band[least] >= band[size] - 1
        assert (least + size) // 7 <= N.blocks_of(band[size], starts)[1]


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 500, dtype=np.uint64)
    for _ in range(50):
        one = np.sort(rnd.choice(pool, rnd.integers(1, 400), replace=False))
        two = np.sort(rnd.choice(pool, rnd.integers(1, 400), replace=False))
        both = np.concatenate([one, two])
        a, b = N.small_sketches(both, np.array([0, len(one), len(both)]))
        assert N.apart(a, b) <= len(np.setxor1d(one, two))


@pytest.mark.parametrize("size", [1 << 21, 64])
def test_hashes_agree_with_sets(monkeypatch, size):
    monkeypatch.setattr(W, "SLICE", size)
    texts = ["a b c d e f", "A B c  d\te f", "", None, "x", "x y", "É b c", "a" * 100, "\n\n"]
    texts += [t for _, t, _ in corpus(3, 60, 5, 0.1, 0.5)]
    hashes, first = W.shingles(*W.words_of(pa.array(texts)))
    own = [set(hashes[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    want = [sets(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.createDataFrame([(1000, 1001), (1001, 1002)], "a bigint, b bigint"))
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_rounds_leave_few_files(spark, monkeypatch):
    """Whatever the partitions of a shuffle, a few edges need a few files."""
    files = []

    def counted(df):
        files.append(df.rdd.getNumPartitions())
        return pin(df)

    monkeypatch.setattr(C, "pin", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r.component for r in components(edges).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 3 and set(files[1:]) == {1}  # the first holds what was handed over


def clusters(seed, bases):
    """Groups of near copies, and stragglers that are near to one of a group at most."""
    rnd = random.Random(seed)

    def edited(own, count):
        own = list(own)
        for at in rnd.sample(range(len(own)), count):
            own[at] = f"e{rnd.randrange(10**9)}"
        return own

    near, far = [], []
    for _ in range(bases):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([80, 120, 200]))]
        group = [edited(base, len(base) // 60) for _ in range(12)]
        near += group
        far += [edited(rnd.choice(group), len(base) // 40) for _ in range(4)]
    return [" ".join(x) for x in near], [" ".join(x) for x in far]


def test_group_hot_in_one_map_task_with_stragglers_in_others(documents):
    near, far = clusters(5, 60)
    rows = [(i, t, "s") for i, t in enumerate(near + far)]
    parts = [rows[: len(near)], rows[len(near) :: 2], rows[len(near) + 1 :: 2]]
    tables = [documents(part, 1) for part in parts]
    docs = tables[0].unionAll(tables[1]).unionAll(tables[2])
    found = N.linked(docs, hot=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


@pytest.mark.parametrize("buckets", [1, 4])
def test_classes_meet_in_as_many_lists_as_they_share_blocks(buckets):
    near, far = clusters(6, 2)
    blocks, runs = {}, []
    for texts in (near, far[::2], far[1::2]):
        column = pa.array(texts)
        sender = N._Sender(buckets, 3)
        sender.add(column, N._class_ids(column))
        runs += sender.runs()
        hashes, first = W.shingles(*W.words_of(column))
        who, lanes, values, *_ = N.sketched(hashes, first)
        ids = N._class_ids(column)
        for w, lane, value in zip(who.tolist(), lanes.tolist(), values.tolist()):
            blocks.setdefault((int(ids[w]), lane), set()).add(value)
    held = {}
    for b in {r[0] for r in runs}:
        for row in N._merged(pa.Table.from_batches([N._batch([r for r in runs if r[0] == b], N._RUNS)])).to_pylist():
            for c in row["members"]:
                own = held.setdefault((c, row["lane"]), {})
                own[row["list"]] = max(own.get(row["list"], 0), row["times"])
    for a, lane in blocks:
        for b, other in blocks:
            if a < b and lane == other and (shared := blocks[a, lane] & blocks[b, lane]):
                one, two = held.get((a, lane), {}), held.get((b, lane), {})
                both = one.keys() & two.keys()
                assert sum(one[n] for n in both) >= len(shared) <= sum(two[n] for n in both)


@pytest.mark.parametrize("words", range(7))
def test_slices_of_few_words(words):
    """A slice may hold fewer words in all than a shingle has."""
    for texts in (["a b c d e f g"[: 2 * words]], ["a b c d e f g"[: 2 * words], "", "x"]):
        values, first = W.words_of(pa.array(texts))
        _, starts = W.shingles(values, first)
        counts = [len(t.split()) for t in texts]
        assert np.diff(starts).tolist() == [max(n - 4, min(n, 1)) for n in counts]


def test_partitions_of_one_row(spark):
    texts = [" ".join("abcdefg"[:n]) for n in (0, 1, 2, 3, 3, 6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6, "doc_id")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.linked(df).collect()}
    assert found == {0: (0, 0), 1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 3), 5: (2, 5)}


def listed(texts, **columns):
    column = pa.array(texts)
    hashes, first = W.shingles(*W.words_of(column))
    names = np.arange(len(texts)) * 7 + 1
    same = {c: np.zeros(len(texts), np.int64) for c in ("clump", "low", "high", "block")}
    return pa.table({
        "class": names, "component": names, "size": np.diff(first), "text": column,
        "sketch": pa.array(N.small_sketches(hashes, first), pa.binary()), **same, **columns,
    })


@pytest.mark.parametrize("work", ["_forest", "_links"])
def test_fewer_pairs_than_classes_leave_a_large_group(work):
    near, far = clusters(7, 10)
    base, rnd = near[0].split(), random.Random(2)
    group = []
    for _ in range(150):  # about as far from each other as links may be
        own = list(base)
        for at in rnd.sample(range(len(own)), max(1, len(own) // 60)):
            own[at] = f"x{rnd.randrange(10**9)}"
        group.append(" ".join(own))
    texts = group + near[12:] + far
    pairs = []
    getattr(N, work)(listed(texts), pairs)
    assert len(pairs) < len(texts)
    low = list(range(len(texts)))
    for a, b in pairs * len(texts):
        a, b = (a - 1) // 7, (b - 1) // 7
        if low[a] == low[b]:
            continue
        low[a] = low[b] = min(low[a], low[b])
    want = brute([(i, t, "s") for i, t in enumerate(texts)])
    if work == "_links":
        assert low == [want[i][1] for i in range(len(texts))]
    else:  # a clump may hold several components, and cuts none
        assert len({(low[i], want[i][1]) for i in low}) <= len({w for _, w in want.values()})


def test_clumps_of_many_blocks(documents, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 6)
    near, far = clusters(8, 4)
    rows = [(i, t, "s") for i, t in enumerate(near + far)]
    found = N.linked(documents(rows, 3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_bands_have_buckets_of_their_own(monkeypatch):
    """The name of a class goes to the buckets of its two bands, not to all buckets."""
    monkeypatch.setattr(N, "BUCKET", 500)
    texts = [" ".join(f"w{i}x{j}" for j in range(60 * 2 ** (i % 4))) for i in range(40)]
    column = pa.array(texts)
    hashes, first = W.shingles(*W.words_of(column))
    who, lanes, _, _, _, band = N.sketched(hashes, first)
    sizes = {}
    for b, n in zip(band.tolist(), np.diff(first).tolist()):
        sizes[b] = sizes.get(b, 0) + n
    plan = N._dealt(sizes)
    total = plan[-1][0] + (1 << plan[-1][1])
    spans = sorted(set(plan))
    assert [a + (1 << bits) for a, bits in spans] == [a for a, _ in spans[1:]] + [total] and total > 8
    sender = N._Sender(plan, 200)
    sender.add(column, N._class_ids(column))
    ids, held, blocks = N._class_ids(column), {}, 0
    for bucket, names, keys, *_ in sender.runs():
        blocks += len(N._unpack(keys))
        for c in np.frombuffer(names, "<i8").tolist():
            held.setdefault(c, set()).add(bucket)
    assert blocks == len(who)
    for c, b in zip(ids.tolist(), band.tolist()):
        own = [set(range(plan[x][0], plan[x][0] + (1 << plan[x][1]))) for x in (b, b + 1)]
        assert held[c] <= own[0] | own[1] < set(range(total))


def test_many_buckets(documents, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 200)
    near, far = clusters(9, 40)
    rows = [(i, t, "s") for i, t in enumerate(near + far)]
    for hot in (3, 200):
        found = N.linked(documents(rows, 3), hot=hot).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_sizes_of_lists_are_known_to_their_buckets():
    texts = [" ".join(f"w{j}" for j in range(40)) + f" end{i}" for i in range(12)]
    column = pa.array(texts)
    for hot, known in ((200, {True}), (3, {False})):
        runs = []
        for at in (0, 6):
            sender = N._Sender(1, hot)
            sender.add(column[at : at + 6], N._class_ids(column[at : at + 6]))
            runs += sender.runs()
        found = N._merged(pa.Table.from_batches([N._batch(runs, N._RUNS)])).to_pylist()
        long = [r for r in found if len(r["members"]) > 3]
        assert long and {r["n"] == len(r["members"]) for r in long} == known
