"""Compression classifier: held-out accuracy and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from dosewise.llm import quality
from dosewise.llm.common import table
from dosewise.llm.queries import op10_compression_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op10_compression_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0) & (got.score <= 1) & (got.predicted == (got.score >= 0.7))).all()
    unseen = got[got.held_out]
    assert (unseen.predicted == unseen.quality).mean() > 0.97
    assert unseen[unseen.quality == 1].predicted.mean() > 0.98


def test_held_out_labels_are_not_read(spark, docs):
    rows = [(i, f"word {i} text of some length here") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs(rows), labels), quality.fit(docs(rows), flipped)
    assert a.good == b.good and a.bad == b.bad and np.array_equal(a.weights, b.weights)


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (None, "x"), (3, "long " * 200_000), (4, "a"), (4, "a")]
    empty = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1), (99, 1)], "doc_id long, quality int")
    for labels in (empty, odd):
        model = quality.fit(docs(rows), labels)
        got = docs(rows).select(quality.score(F.col("text"), model).alias("s")).collect()
        assert len(got) == 6 and all(0 <= r.s <= 1 for r in got)
    assert docs([]).select(quality.score(F.col("text"), model)).count() == 0
    assert quality.keep_good(docs(rows), model, 0.0).columns == docs(rows).columns
