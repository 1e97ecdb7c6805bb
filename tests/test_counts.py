import math

import pytest
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import counts as K
from dosewise.operators import metrics, vectors


def test_grouped_sum_leaves_out_bad_cells(spark):
    cells = spark.createDataFrame([(1, "A", "normal"), (2, "A", "normal"), (3, "B", "normal"), (4, "B", "doublet")], "cell int, entity string, quality string")
    counts = spark.createDataFrame([(1, 1, 2), (1, 2, 4), (1, 3, 8), (2, 1, 1), (2, 4, 9)], "feature int, cell int, x long")
    good = K.normal_cells(cells)
    sums = {(r.entity, r.feature): r.total for r in K.pseudobulk(counts.join(good, "cell"), ["entity"]).collect()}
    assert sums == {("A", 1): 6, ("B", 1): 8, ("A", 2): 1}
    assert {r.entity: r.n_cells for r in K.cells_per_group(good, ["entity"]).collect()} == {"A": 2, "B": 1}


def test_log1p_cpm(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 3), ("b", 2, 1)], "entity string, feature int, total long")
    got = {(r.entity, r.feature): (r.library_size, r.log1p_cpm) for r in K.normalised(df, ["entity"]).collect()}
    assert got["a", 1] == (2, pytest.approx(math.log1p(5e5)))
    assert got["b", 1] == (4, pytest.approx(math.log1p(7.5e5)))


def test_eligibility(spark):
    df = spark.createDataFrame([("a", 15, 10, 20)], "entity string, early long, late long, treated long")
    row = K.cohort_flags(df, "early", "late", "treated").first()
    assert (row.control_pooled, row.strict_eligible, row.pooled_eligible) == (25, False, True)


def test_group_eligibility(spark):
    rows = [(e, c, h, 9 if (e, c, h) == ("b", "control", 3) else 10 + h) for e in "ab" for c in ("control", "treated") for h in S.HOURS]
    rows = [(e, c, h, 10 if n == 13 else n) for e, c, h, n in rows] + [("a", "untreated", 48, 1)]
    df = spark.createDataFrame(rows, "entity string, condition string, hour int, n_cells long")
    got = {r.entity: r for r in K.group_eligibility(df, "entity").collect()}
    assert (got["a"].eligible_t10, got["b"].eligible_t10, got["a"].eligible_t20) == (True, False, False)
    assert got["a"].n_groups == 10


@pytest.mark.parametrize("tag,condition,hour", [
    ("DMSO_3hr", "control", 3), ("Tram_48hr", "treated", 48), ("Untreated_48hr", "untreated", 48),
    ("unknown", None, None), ("multiplet", None, None), ("Untreated_24hr", None, None), ("xDMSO_3hr", None, None), (None, None, None),
])
def test_tags(spark, tag, condition, hour):
    df = spark.createDataFrame([(tag,)], "tag string")
    row = df.select(S.tag_condition("tag").alias("c"), S.tag_hour("tag").alias("h")).first()
    assert (row.c, row.h) == (condition, hour)


def test_feature_mask(spark):
    rows = [(f"e{i}", h, f, t) for i in range(10) for h in (6, 24) for f, t in ((1, 10), (2, 1))]
    df = spark.createDataFrame(rows, "entity string, hour int, feature int, total long")
    assert [r.feature for r in K.control_feature_mask(df).collect()] == [1]


def test_densify_fills_every_index(spark):
    df = spark.createDataFrame([("a", 2, 1.5), ("a", 4, 2.0), ("b", 1, 3.0)], "entity string, i int, v double")
    got = K.densify(df, ["entity"], "i", 4, ["v"]).toPandas().pivot(index="entity", columns="i", values="v")
    assert got.loc["a"].tolist() == [0.0, 1.5, 0.0, 2.0]
    assert got.loc["b"].tolist() == [3.0, 0.0, 0.0, 0.0]


def test_constant_vector_has_no_correlation(spark):
    df = spark.createDataFrame([("k", i, float(v), 0.0, 0.0) for i, v in enumerate([1, 2, 3])], "k string, feature int, observed double, predicted double, baseline double")
    row = metrics.line_metrics(df, ["k"], k=1).first()
    assert row.pcc_delta is None and row.spearman_delta is None
    assert row.rmse_delta == pytest.approx(math.sqrt(14 / 3))


def test_signed_topk(spark):
    values = [-3, -2, -1, 1, 2, 3]
    same = [("same", i, float(v), float(v)) for i, v in enumerate(values)]
    back = [("back", i, float(v), float(-v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(same + back, "k string, feature int, observed double, predicted double")
    got = {r.k: r.signed_topk_overlap for r in metrics.signed_topk(df, ["k"], "observed", "predicted", "feature", 2).collect()}
    assert got == {"same": 1.0, "back": 0.0}


def test_group_mean_fallback(spark):
    train = spark.createDataFrame(
        [(0, g, 0, float(v)) for g, n, v in (("a", 8, 1), ("b", 6, 2), ("rare", 1, 9)) for _ in range(n)], "model_fold int, g string, feature int, value double"
    )
    test = spark.createDataFrame([(0, "a"), (0, "b"), (0, "unseen"), (0, "rare")], "model_fold int, g string")
    got = {r.g: (r.predicted, r.fallback) for r in vectors.group_mean_with_fallback(train, test, ["model_fold"], "g", "feature", "value").collect()}
    overall = (8 * 1 + 6 * 2 + 9) / 15
    assert got["a"] == (1.0, False) and got["b"] == (2.0, False)
    assert got["unseen"] == (pytest.approx(overall), True) and got["rare"] == (pytest.approx(overall), True)


def test_nan_is_not_over_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert [r[0] for r in df.select(S.over_threshold("v", 0)).collect()] == [False, False, True]
    assert [r[0] for r in df.select(S.is_finite(F.col("v"))).collect()] == [False, False, True]
