"""Queries whose buckets hold too few vectors are compared with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.llm import crosspolytope
from test_crosspolytope import brute


@pytest.mark.parametrize("size,dim,part_rows", [(300, 256, 64), (3, 128, 4096), (6, 64, 2)])
def test_outlier_beside_a_tight_cluster(spark, monkeypatch, size, dim, part_rows):
    monkeypatch.setattr(crosspolytope, "PART_ROWS", part_rows)
    rng = np.random.default_rng(2)
    center = rng.normal(size=dim)
    x = center + rng.normal(size=(size, dim)) * 1e-3
    x[0] = rng.normal(size=dim)
    ids = list(range(size))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = crosspolytope.search(frame, F.col("vec_id") == 0).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [i for i, _ in brute(ids, x, (0, x[0]), 5)] and len(got) == min(5, size - 1)
