"""Vector search: recall against brute force, exact scores, hot vectors and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.llm import crosspolytope
from dosewise.llm.common import table
from dosewise.llm.queries import op6_cross_polytope_search

SF = "/root/testdata/sf0.1"


def brute(ids, x, query, k):
    score = {i: float((v * query[1]).sum() / np.sqrt((v * v).sum()) / np.sqrt((query[1] ** 2).sum())) for i, v in zip(ids, x) if i != query[0]}
    return sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]


def test_recall(spark):
    rows = table(spark, SF, "embeddings").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding.tolist()).astype(float), rows.vec_id.tolist()
    got = op6_cross_polytope_search(spark, SF).toPandas()
    hits = total = 0
    for q in ids[::50]:
        own = got[got.query_id == q].sort_values("rank")
        want = brute(ids, x, (q, x[ids.index(q)]), 5)
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.score.is_monotonic_decreasing
        scores = dict(brute(ids, x, (q, x[ids.index(q)]), len(ids)))
        assert np.allclose(own.score, [scores[i] for i in own.vec_id], rtol=0, atol=1e-12)
        hits += len(set(own.vec_id) & {i for i, _ in want})
        total += 5
    assert hits / total >= 0.93


def test_hot_vectors_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "PART_ROWS", 8)
    rng = np.random.default_rng(0)
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(100, 400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 460)]
    rows += [(0, hot), (50, [2.0, 4.0, 6.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 1.0]), (5, [float("inf"), 1.0, 1.0]),
             (6, []), (None, hot), (7, [1.0, 2.0]), (150, [3.0, 2.0]), (100, hot)]
    table_ = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = crosspolytope.search(table_, F.col("vec_id") % 50 == 0, 5).toPandas()
    first = got[got.query_id == 0].sort_values("rank")
    assert first.vec_id.tolist() == [50, 100, 101, 102, 103] or first.vec_id.tolist() == [100, 101, 102, 103, 104]
    assert not set(got.vec_id) & {1, 2, 3, 4, 5, 6} and 150 in set(got.query_id)
    assert (got.query_id != got.vec_id).all() and got.groupby("query_id").size().max() <= 10


def test_rotation_keeps_lengths_and_padding():
    x = np.random.default_rng(1).normal(size=(20, 48))
    turned = crosspolytope.rotated(x, 3)
    assert turned.shape == (20, 64) and np.allclose((turned**2).sum(1), 64**3 * (x**2).sum(1))
    near = crosspolytope.axes(x, 3, 4)
    assert np.array_equal(near[:, 0], crosspolytope.axes(x * 7, 3, 1)[:, 0])


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 0.0])]])
def test_nothing_to_find(spark, rows):
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert crosspolytope.search(table_, F.col("vec_id") % 50 == 0).count() == 0
