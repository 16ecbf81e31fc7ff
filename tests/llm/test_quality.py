from __future__ import annotations

import zlib

import numpy as np
import pytest

from plumbline.llm import quality as Q
from plumbline.llm.rows import table


def test_held_out_accuracy(spark, folder):
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))
    found = Q.quality(docs, labels)
    assert found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out").collect()
    for r in held:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    right = np.mean([r.predicted == r.quality for r in held])
    kept = np.mean([r.predicted for r in held if r.quality == 1])
    assert right >= 0.97 and kept >= 0.98
    assert found.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").count() == 0


def test_held_out_labels_are_not_learned_from(spark, folder):
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))
    from pyspark.sql import functions as F

    spoilt = labels.withColumn(
        "quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = Q.learn(docs, labels), Q.learn(docs, spoilt)
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut


def test_pairs_decide_the_order():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(400, Q.FEATURES))
    good = x[:, 2] + 0.1 * rnd.normal(size=400) > 0
    ranker = Q.Ranker(x, good)
    scores = ranker(x)
    assert ((scores >= Q.CUT) == good).mean() > 0.9


def test_odd_rows(odd, spark, documents):
    labels = spark.createDataFrame(
        [(5, 0, 0), (6, 1, 0), (6, 1, 1), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    found = Q.quality(odd, labels)
    assert found.count() == odd.count()
    # nothing to prefer: every text scores the cut, and all are kept
    none = Q.quality(odd, labels.limit(0))
    assert [r.score for r in none.collect()] == pytest.approx([Q.CUT] * odd.count())
    kept = Q.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert Q.quality(documents([]), labels).count() == 0
