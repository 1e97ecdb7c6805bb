import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import counts as K
from dosewise.operators import composition, encoders, enrichment, linear, metrics, neighbors, vectors
from dosewise.plans import benchmark
from dosewise.session import BLOCK_ROWS_KEY

N, D, G = 30, 6, 4


@pytest.fixture(scope="module")
def nested(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(N, D)), rng.normal(size=(N, G))
    groups = ["a" if i % 2 else f"g{i % 3}" for i in range(N)]
    df = spark.createDataFrame([(i, groups[i], x[i].tolist(), y[i].tolist()) for i in range(N)], "entity int, lineage string, x array<double>, y array<double>")
    rows, names, _, _ = benchmark.nested_rows(df, "entity", "lineage", 3, 2, 4)
    return rows, names, x, y, groups


def held(rows, fold):
    return {r.entity for r in rows.select("entity", "held_of").collect() if fold in r.held_of}


def test_mean_predictors_of_every_fold(nested):
    rows, names, _, y, groups = nested
    got = benchmark.mean_predictions(rows, names, "lineage").toPandas()
    assert set(got.model_fold) == set(names)
    for fold, part in got.groupby("model_fold"):
        train = [i for i in range(N) if i not in held(rows, fold)]
        for r in part.itertuples():
            same = [i for i in train if groups[i] == groups[r.entity]]
            assert r.global_mean == pytest.approx(y[train, r.feature].mean())
            expected = y[same, r.feature].mean() if len(same) >= 2 else y[train, r.feature].mean()
            assert r.group_mean == pytest.approx(expected) and r.fallback == (len(same) < 2)


def test_selection_is_the_pooled_minimum(nested):
    rows, names, *_ = nested
    fitted = benchmark.fit(rows, names, 3, 3)
    grid = benchmark.Grid(dimensions=(1, 3), alphas=(1.0, 50.0), ranks=(1, 2))
    losses = benchmark.grid_losses(fitted, grid.direct() + grid.low_rank())
    trace, chosen = benchmark.select_settings(losses)
    table = losses.toPandas()
    inner = table[table.model_fold.str.contains("/")].assign(outer=lambda d: d.model_fold.str.split("/").str[0])
    pooled = inner.groupby(["outer", "setting", "dimension", "rank", "alpha"])["rmse"].mean()
    for r in chosen.collect():
        assert r.loss == pytest.approx(pooled[r.outer_fold, r.setting].min())
    assert trace.count() == 6 * (4 + 8)
    outer = benchmark.chosen_predictions(fitted, grid.direct(), chosen.where("setting = 'direct'")).toPandas()
    assert sorted(outer.entity) == list(range(N)) and not outer.model_fold.str.contains("/").any()


def test_novelty_is_the_nearest_training_distance(nested):
    rows, names, x, _, _ = nested
    fitted = benchmark.fit(rows, names, 2)
    got = benchmark.novelty(fitted, 2).toPandas()
    scores = linear.scores(rows, fitted.control, "x", names, whiten=True).toPandas()
    for fold, part in scores.groupby("model_fold"):
        z = {r.entity: np.asarray(r.z) for r in part.itertuples()}
        train = part[part.role == "train"].entity
        for r in got[got.model_fold == fold].itertuples():
            assert r.novelty == pytest.approx(min(np.linalg.norm(z[r.entity] - z[t]) for t in train))


def test_baselines_copy_few_rows(spark, conf, monkeypatch):
    """The nearest row of the five predictors is found without copies of all training rows to all blocks of held-out ones."""
    conf(BLOCK_ROWS_KEY, 8)
    copies, plain = [], neighbors.fresh
    monkeypatch.setattr(neighbors, "fresh", lambda df: (copies.append(df.count()), plain(df))[1])
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, D))
    df = spark.createDataFrame([(i, f"g{i % 3}", x[i].tolist(), x[i, :G].tolist()) for i in range(400)], "entity int, lineage string, x array<double>, y array<double>")
    rows, names, _, _ = benchmark.nested_rows(df, "entity", "lineage", 3, 2, 4)
    fitted = benchmark.fit(rows, names, 2)
    losses = benchmark.grid_losses(fitted, benchmark.Grid(dimensions=(1, 2), alphas=(1.0,)).direct())
    got = benchmark.baseline_losses(fitted, "lineage", losses, (1, 2)).toPandas()
    assert (got.groupby("model").entity.nunique() == 400).all() and len(got) == 2000
    z = linear.scores(rows, fitted.control, "x", names, whiten=True).where("model_fold = '0'").toPandas().set_index("entity")
    train = z[z.role == "train"].sort_index()
    for r in got[(got.model == "nearest") & (got.model_fold == "0")].itertuples():
        gaps = np.square(np.stack(train.z)[:, : int(r.dimension)] - z.z[r.entity][: int(r.dimension)]).sum(axis=1)
        assert r.neighbor == train.index[gaps.argmin()]
    # training rows: 267 of each outer fold and 178 of each inner one, for each of two dimensions
    assert sum(copies) < 4 * 2 * (3 * 267 + 6 * 178)


def test_scores_of_training_rows_are_whitened(nested):
    rows, names, *_ = nested
    fitted = benchmark.fit(rows, names, 3)
    scores = linear.scores(rows, fitted.control, "x", names, whiten=True).where("role = 'train'").toPandas()
    for _, part in scores.groupby("model_fold"):
        z = np.stack(part.z)
        np.testing.assert_allclose(np.cov(z.T), np.eye(3), atol=1e-9)


def test_external_entities_only(nested, spark):
    rows, *_ = nested
    table = rows.select("entity", "x", "y")
    out = benchmark.external_transfer(table.where("entity < 20"), table, linear.Setting("direct", 2, 10.0), 2).collect()
    assert sorted(r.entity for r in out) == list(range(20, N))


def test_long_and_array_layouts(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "entity string, vector array<double>")
    long = vectors.to_long(df, ["entity"], "vector")
    back = {r.entity: r.vector for r in vectors.to_array(long, ["entity"], "feature", "value").collect()}
    assert back == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    wanted = spark.createDataFrame([(0, "b"), (1, "z")], "pos int, entity string")
    got = {r.entity: r.vector for r in vectors.aligned(df, wanted, "entity").collect()}
    assert got == {"b": [3.0, 4.0], "z": None}


def test_tagged_cells_and_paired_keys(spark):
    cells = spark.createDataFrame(
        [("a", "DMSO_3hr", "normal"), ("a", "Tram_3hr", "normal"), ("b", "DMSO_6hr", "normal"), ("a", "DMSO_6hr", "doublet"), ("a", "unknown", "normal")],
        "entity string, tag string, quality string",
    )
    kept = K.tagged_cells(cells, "tag")
    assert kept.count() == 3
    assert K.tagged_cells(cells, "tag", ids=cells.where("entity = 'b'").select("entity")).count() == 1
    assert [r.entity for r in K.paired_keys(kept, ["entity"]).collect()] == ["a"]
    with pytest.raises(ValueError):
        K.require_pairs(kept, ["entity"])
    assert K.require_pairs(kept.where("entity = 'a'"), ["entity"]).count() > 0


def test_panel_keeps_every_column_of_a_symbol(spark):
    genes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "gene_idx int, symbol string")
    panel = spark.createDataFrame([("A",), ("A",), ("Z",)], "symbol string")
    assert sorted(r.gene_idx for r in enrichment.panel_features(genes, panel).collect()) == [1, 3]


def test_wide_table_and_component_summary(spark):
    tall = spark.createDataFrame([("m", "rmse", 1.0), ("m", "rmse", 3.0), ("m", "pcc", float("nan"))], "model string, metric string, value double")
    row = metrics.wide(metrics.macro_summary(tall, ["model"]), ["model"], ["rmse", "pcc"], ["macro_mean", "n"]).first()
    assert (row.rmse_macro_mean, row.rmse_n, row.pcc_n) == (2.0, 2, None)


def test_symmetric_matrix(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5)], "l string, r string, v double")
    got = {r.l: (r.a, r.b) for r in enrichment.symmetric_matrix(pairs, "l", "r", "v", ["a", "b"]).collect()}
    assert got == {"a": (1.0, 0.5), "b": (0.5, 1.0)}


def test_lines_below_the_rare_limit_are_lumped(spark):
    df = spark.createDataFrame([(i, "big" if i < 5 else "small") for i in range(7)], "entity int, lineage string")
    got = {r.lineage: r.display_group for r in vectors.display_groups(df, "lineage").collect()}
    assert got == {"big": "big", "small": "other / rare"}
    assert vectors.representative(df, [F.asc("entity")]).first().entity == 3


def test_lookups_refuse_repeats_and_missing_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", 4.0)], "entity string, v double")
    wanted = lambda *names: spark.createDataFrame(list(enumerate(names)), "pos int, entity string")
    assert sorted((r.pos, r.v) for r in vectors.aligned(rows, wanted("c", "a"), "entity", complete=True).collect()) == [(0, 4.0), (1, 1.0)]
    for bad in (("a", "b"), ("a", "a"), ("a", "x")):
        with pytest.raises(ValueError):
            vectors.aligned(rows, wanted(*bad), "entity", complete=True)
    once = rows.where("v != 3")
    assert composition.one_to_one(once, once.withColumnRenamed("v", "w"), ["entity"]).count() == 3
    with pytest.raises(ValueError):
        composition.one_to_one(once, rows.withColumnRenamed("v", "w"), ["entity"])
    genes = spark.createDataFrame([(1, "A")], "gene_idx int, symbol string")
    with pytest.raises(ValueError):
        enrichment.panel_features(genes, spark.createDataFrame([("Z",)], "symbol string"))


def test_other_values_and_short_vectors_are_errors(spark):
    train = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.0, 2.0)], "model_fold string, p double, q double")
    assert encoders.binary_scales(train, ["model_fold"], ["p"]).first().mean == 0.5
    with pytest.raises(Exception, match="other than 0 and 1 in q"):
        encoders.binary_scales(train, ["model_fold"], ["p", "q"]).collect()
    rows = spark.createDataFrame([("k", i, float(i), float(-i)) for i in range(5)], "k string, feature int, observed double, predicted double")
    with pytest.raises(Exception, match="fewer than 6 features"):
        metrics.signed_topk(rows, ["k"], "observed", "predicted", "feature", 3).collect()
