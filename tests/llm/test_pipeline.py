from __future__ import annotations

import os
import sys

from .test_exact import brute as exact_brute
from .test_ngram_join import brute as near_brute
from .test_packing import FILE

from plumbline.llm import packing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402


def as_rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.orderBy("doc_id").collect()]


def test_each_stage_on_what_its_predecessor_kept(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_filter", "exact_dedup", "near_dedup", "mix", "pack"
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [as_rows(docs)]
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if name != "pack":
            assert docs.columns == columns
            seen.append(as_rows(docs))
    whole, good, single, far, mixed = seen

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {i for i, _, _ in good}
    for doc, quality in labels.items():
        assert (doc in kept) == bool(quality)

    keep = {i for i, (_, _, k, _) in exact_brute(good).items() if k}
    assert {i for i, _, _ in single} == keep
    low = {c for _, c in near_brute(single).values()}
    assert {i for i, _, _ in far} == low

    copies = {}
    for i, _, _ in mixed:
        copies[i] = copies.get(i, 0) + 1
    assert set(copies) <= low and max(copies.values()) <= 2
    words = lambda rows: sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(words(mixed) / words(far) - 1.5) < 0.1

    pieces = docs.collect()
    once = [p for p in pieces if copies[p.doc_id] == 1]
    texts = {i: t for i, t, _ in mixed}
    encoder = packing.encoder(FILE)
    assert sum(p.length for p in pieces) == sum(
        n * (len(encoder(texts[i])) // 4 + 1) for i, n in copies.items()
    )
    by_sequence = {}
    for p in pieces:
        by_sequence[p.sequence_id] = by_sequence.get(p.sequence_id, 0) + p.length
    assert max(by_sequence.values()) <= 4096
    # documents taken once come back whole
    check_docs = {p.doc_id for p in once}
    for doc in list(check_docs)[:50]:
        own = sorted((p for p in once if p.doc_id == doc), key=lambda p: p.start)
        assert sum(p.length for p in own) == own[0].doc_tokens


def test_run_applies_all_stages(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    ]
    assert found.count() > 0
