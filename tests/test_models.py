import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import distances, encoders, folds, linear, neighbors
from dosewise.operators.linear import Setting
from dosewise.plans import ablation, benchmark, robustness
from dosewise.session import BLOCK_ROWS_KEY, BROADCAST_BYTES_KEY

N, D, G = 40, 12, 9


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, D)) * np.linspace(3, 1, D) + 1
    y = x[:, :3] @ rng.normal(size=(3, G)) + rng.normal(size=(N, G)) * 0.1
    groups = [f"g{i % 4}" for i in range(N)]
    df = spark.createDataFrame(
        [(i, groups[i], x[i].tolist(), y[i].tolist(), [float(i % 2), float(i % 3 == 0)]) for i in range(N)],
        "entity int, lineage string, x array<double>, y array<double>, extra array<double>",
    )
    return df, x, y


@pytest.fixture(scope="module")
def keyed(spark, table):
    rows, names, outer, inner = benchmark.nested_rows(table[0], "entity", "lineage", 4, 3, 5)
    return rows, names, outer, inner


def train_index(keyed, fold):
    pdf = keyed[0].select("entity", "held_of").toPandas()
    return sorted(e for e, h in zip(pdf.entity, pdf.held_of) if fold not in h)


def whitened(x, train, k):
    centre = x[train].mean(axis=0)
    u, s, vt = np.linalg.svd(x[train] - centre, full_matrices=False)
    return lambda rows: (rows - centre) @ vt[:k].T / (s[:k] / np.sqrt(len(train) - 1))


def test_folds_are_balanced_and_disjoint(keyed):
    outer, inner = keyed[2].toPandas(), keyed[3].toPandas()
    sizes = outer.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 4
    spread = outer.groupby(["lineage", "fold"]).size().unstack(fill_value=0)
    assert (spread.max(axis=1) - spread.min(axis=1)).max() <= 1
    own = outer.set_index("entity")["fold"]
    assert (inner["outer_fold"] != inner["entity"].map(own)).all()
    for fold in keyed[1]:
        train = set(train_index(keyed, fold))
        tested = {r.entity for r in keyed[0].where(F.array_contains("test_of", fold)).collect()}
        assert tested and not train & tested


@pytest.mark.parametrize("size,sizes", [(23, (9, 6, 5, 3))])
def test_large_group_reaches_every_fold(spark, size, sizes):
    groups = [g for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(groups)), "entity int, lineage int")
    dealt = folds.deal_folds(df, "entity", "lineage", 5, 11).toPandas()
    counts = dealt.groupby("fold").size()
    assert counts.max() - counts.min() <= 1 and len(dealt) == size
    assert dealt[dealt.lineage == 0]["fold"].nunique() == 5
    assert bool(folds.fold_balance(spark.createDataFrame(dealt), "entity", "fold", 5).first().balanced)


def test_one_fold_is_refused(spark):
    df = spark.createDataFrame([(1, 1)], "entity int, lineage int")
    with pytest.raises(ValueError):
        folds.deal_folds(df, "entity", "lineage", 1, 1)


def test_ridge_matches_dense_solution(keyed, table):
    _, x, y = table
    rows, names, *_ = keyed
    fitted = benchmark.fit(rows, names, 5, 4)
    got = linear.fold_predictions(rows, fitted.models(), [Setting("direct", 3, 2.0), Setting("low_rank", 3, 2.0, 2)], names, 5).collect()
    assert got
    for r in got:
        train = train_index(keyed, r.model_fold)
        z = whitened(x, train, 3)
        zt, centre = z(x[train]), y[train].mean(axis=0)
        w = np.linalg.solve(zt.T @ zt + 2.0 * np.eye(3), zt.T @ (y[train] - centre))
        p = centre + z(x[[r.entity]])[0] @ w
        if r.setting == "low_rank":
            v = np.linalg.svd(y[train] - centre, full_matrices=False)[2][:2].T
            p = centre + (p - centre) @ v @ v.T
        np.testing.assert_allclose(r.predicted, p, atol=1e-9)


def test_extra_covariates_are_standardised_on_training_rows(keyed, table):
    _, x, y = table
    rows, names, *_ = keyed
    fitted = benchmark.fit(rows, names[:4], 4, extra="extra", scaled=1)
    got = linear.fold_predictions(rows, fitted.models(), [Setting("v", 2, 1.0, 0, (0, 1))], names[:4], 4, extra="extra").collect()
    for r in got:
        train = train_index(keyed, r.model_fold)
        z = whitened(x, train, 2)
        e = np.array([[i % 2, i % 3 == 0] for i in range(N)], dtype=float)
        sd = np.array([1.0, e[train, 1].std()])
        full = np.hstack([z(x), e / sd])
        centre, target = full[train].mean(axis=0), y[train].mean(axis=0)
        d = full[train] - centre
        w = np.linalg.solve(d.T @ d + np.eye(4), d.T @ (y[train] - target))
        np.testing.assert_allclose(r.predicted, target + (full[r.entity] - centre) @ w, atol=1e-9)


def test_shuffled_models_equal_broadcast_models(keyed, conf):
    rows, names, *_ = keyed
    fitted = benchmark.fit(rows, names, 3)
    run = lambda: {(r.model_fold, r.entity): r.rmse for r in benchmark.grid_losses(fitted, [Setting("direct", 2, 1.0)]).collect()}
    wide = run()
    # a few folds a pass, then folds over the limit that meet their rows by key
    for most in (4_000, 1):
        conf(BROADCAST_BYTES_KEY, most)
        small = run()
        assert wide.keys() == small.keys()
        assert all(abs(wide[k] - small[k]) < 1e-12 for k in wide)


def test_folds_are_dealt_by_size():
    sizes = {"a": 5, "b": 4, "c": 30, "d": 1, "e": 9}
    assert linear.fold_groups(sizes, 10) == [["a", "b"], ["c"], ["d", "e"]]
    assert linear.fold_groups(sizes, 1) == [["a"], ["b"], ["c"], ["d"], ["e"]]
    assert linear.fold_groups({}, 10) == []


def test_basis_stays_bounded_over_restarts():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 300)) * np.linspace(2, 1, 300)
    square, k = x.T @ x, 6
    fold, done, widths = linear.Krylov(np.zeros((300, 0)), np.zeros((300, 0)), np.linalg.qr(rng.normal(size=(300, k)))[0]), False, []
    for _ in range(200):
        values, vectors, done = fold.advance(square @ fold.block, 2, 4 * k, 1e-9)
        widths.append(fold.basis.shape[1])
        if done:
            break
    assert done and len(widths) > 8 and max(widths) <= 4 * k and widths.count(k) > 2
    exact, axes = np.linalg.eigh(square)
    np.testing.assert_allclose(values, exact[::-1][:2], rtol=1e-9)
    np.testing.assert_allclose(np.abs(np.sum(vectors * axes[:, ::-1][:, :2], axis=0)), 1, atol=1e-8)


@pytest.mark.parametrize("shape", [(60, 150), (240, 150)])
def test_restarted_krylov_equals_dense_decomposition(spark, conf, shape):
    """All size limits lowered, bases compressed on the way, one fold a broadcast."""
    rng = np.random.default_rng(11)
    n, width = shape
    x = rng.normal(size=shape) * np.linspace(2, 1, width) + rng.normal(size=width)
    held = [[f for f in ("a", "b") if i % 5 == "ab".index(f)] for i in range(n)]
    rows = spark.createDataFrame(
        [(i, x[i].tolist(), h, h) for i, h in enumerate(held)],
        "entity int, x array<double>, test_of array<string>, held_of array<string>",
    )
    for key in (linear.GRAM_KEY, linear.DUAL_KEY, BROADCAST_BYTES_KEY):
        conf(key, 1)
    got = linear.fit_pca(rows, "x", ["a", "b"], 2).toPandas().sort_values(["model_fold", "component"])
    assert list(got.component) == [1, 2, 1, 2]
    for fold, part in got.groupby("model_fold"):
        train = x[[fold not in h for h in held]]
        _, s, vt = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)
        np.testing.assert_allclose(part.eigenvalue, s[:2] ** 2 / (len(train) - 1), rtol=1e-8)
        np.testing.assert_allclose(part.explained_ratio, s[:2] ** 2 / (s ** 2).sum(), rtol=1e-8)
        loading = np.stack(part.loading)
        np.testing.assert_allclose(np.abs(np.sum(loading * vt[:2], axis=1)), 1, atol=1e-8)


@pytest.mark.parametrize("max_features", [None, 6])
def test_wide_solvers_match_the_gram_solver(keyed, conf, max_features):
    rows, names, *_ = keyed
    run = lambda: linear.fit_pca(rows, "x", names, 3, max_features=max_features).toPandas().sort_values(["model_fold", "component"])
    base = run()
    conf(linear.GRAM_KEY, 1)
    dual = run()
    conf(linear.DUAL_KEY, 1)
    power = run()
    for other, tolerance in ((dual, 1e-9), (power, 1e-3)):
        np.testing.assert_allclose(base.eigenvalue, other.eigenvalue, rtol=1e-4)
        np.testing.assert_allclose(np.stack(base.loading), np.stack(other.loading), atol=tolerance)


def test_held_out_rows_do_not_change_a_fit(keyed, table, spark):
    rows, names, *_ = keyed
    fold = names[0]
    changed = rows.withColumn("y", F.when(F.array_contains("held_of", fold), F.transform("y", lambda v: v + 1000.0)).otherwise(F.col("y")))
    pick = lambda r: benchmark.fit(r, [fold], 2).moments.first().stat
    np.testing.assert_allclose(pick(rows), pick(changed))


def test_selection_ties_prefer_small_penalties_for_direct(spark):
    rows = [("0/0", "direct", 2, 0, a, 1.0) for a in (10.0, 1.0)] + [("0/0", "low_rank", 2, 3, a, 1.0) for a in (10.0, 1.0)]
    df = spark.createDataFrame(rows, "model_fold string, setting string, dimension int, rank int, alpha double, rmse double")
    chosen = {r.setting: r.alpha for r in benchmark.select_settings(df)[1].collect()}
    assert chosen == {"direct": 1.0, "low_rank": 10.0}


def test_no_feasible_dimension():
    assert benchmark.feasible((5, 2, 2, 90), 10) == (2, 5)
    with pytest.raises(ValueError):
        benchmark.feasible((20,), 10)


def test_variants_share_passes(spark, table):
    df, _, _ = table
    rows = df.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = rows.where("variant = 'a' or entity < 30")
    keyed = robustness.keyed_variants(rows, "lineage", 3, 1)
    losses = robustness.fixed_outer_losses(keyed, ["a", "b"], 3, dimension=3, alpha=1.0).toPandas()
    assert losses.groupby("variant").size().to_dict() == {"a": 40, "b": 30}
    alone = robustness.keyed_variants(rows.where("variant = 'b'"), "lineage", 3, 1)
    again = robustness.fixed_outer_losses(alone, ["b"], 3, dimension=3, alpha=1.0).toPandas().set_index("entity")
    both = losses[losses.variant == "b"].set_index("entity")
    np.testing.assert_allclose(both["direct"].sort_index(), again["direct"].sort_index(), atol=1e-12)


def test_fixed_variant_list():
    names = [v.name for v in ablation.fixed_variants(groups=3, covariates=2)]
    assert len(names) == len(set(names)) == 12 and "RANK_D20_R50" in names and "CONTROL_D05_R20" in names


@pytest.mark.parametrize("block", [4, 1000])
def test_nearest_neighbour_by_blocks(spark, table, conf, block):
    df, x, _ = table
    conf(BLOCK_ROWS_KEY, block)
    q = df.where("entity < 15").select(F.lit("f").alias("model_fold"), "entity", "x")
    t = df.where("entity >= 15").select(F.lit("f").alias("model_fold"), "entity", "x")
    for r in neighbors.nearest(q, t, ["model_fold"], "x", [2, D]).collect():
        gaps = ((x[15:, : r.dimension] - x[r.entity, : r.dimension]) ** 2).sum(axis=1)
        assert r.neighbor == 15 + gaps.argmin() and r.distance == pytest.approx(np.sqrt(gaps.min()))


def by_key(spark, vectors, first=0):
    rows = [(k, first + i, [float(c) for c in v]) for k, part in vectors.items() for i, v in enumerate(part)]
    return spark.createDataFrame(rows, "model_fold string, entity long, z array<double>")


def test_nearest_of_few_dimensions_by_strips(spark, conf):
    """Equal points, equal leading coordinates, far queries, crowded queries, a key without training rows, short vectors."""
    conf(BLOCK_ROWS_KEY, 8)
    rng = np.random.default_rng(4)
    train = {"a": rng.normal(size=(150, 3)), "b": rng.integers(0, 4, size=(150, 3)), "c": np.hstack([np.ones((90, 1)), rng.normal(size=(90, 2))]), "e": np.zeros((40, 3))}
    queries = {
        "a": np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(5, 3)) * 1e3, train["a"][:30], np.zeros((40, 3))]), "b": rng.integers(0, 4, size=(60, 3)),
        "c": rng.normal(size=(40, 3)), "d": rng.normal(size=(3, 3)), "e": rng.normal(size=(3, 3))}
    got = neighbors.nearest(by_key(spark, queries, 1000), by_key(spark, train), ["model_fold"], "z", [1, 2, 3, 4]).collect()
    found = {(r.model_fold, r.entity, r.dimension): (r.neighbor, r.distance) for r in got}
    assert len(found) == len(got) == 3 * sum(len(queries[k]) for k in train)
    for k, t in train.items():
        for i, v in enumerate(queries[k]):
            for d in (1, 2, 3):
                gaps = sum((v[c] - t[:, c]) ** 2 for c in range(d))
                assert found[k, 1000 + i, d] == (gaps.argmin(), np.sqrt(gaps.min()))


def test_nearest_of_few_dimensions_copies_few_rows(spark, conf, monkeypatch):
    """Training rows go to the strips of near queries, not to every block of queries."""
    conf(BLOCK_ROWS_KEY, 64)
    copies, plain = [], neighbors.fresh
    monkeypatch.setattr(neighbors, "fresh", lambda df: (copies.append(df.count()), plain(df))[1])
    rng = np.random.default_rng(5)
    t, q = by_key(spark, {"f": rng.normal(size=(1600, 2))}), by_key(spark, {"f": rng.normal(size=(1600, 2))}, 5000)
    assert neighbors.nearest(q, t, ["model_fold"], "z", [1, 2]).count() == 3200
    assert sum(copies) < 6 * 3200


def test_nearest_with_values_that_are_not_finite(spark):
    t = by_key(spark, {"f": [[1.0, 2.0], [3.0, 1.0]]})
    q = by_key(spark, {"f": [[float("nan"), 0.0], [float("inf"), 0.0], [1e200, 0.0], [3.0, 0.0]]}, 10)
    got = neighbors.nearest(q, t, ["model_fold"], "z", [1, 2]).collect()
    assert sorted((r.entity, r.dimension) for r in got) == [(e, d) for e in (10, 11, 12, 13) for d in (1, 2)]
    assert {r.neighbor for r in got if r.entity == 13} == {1}


@pytest.mark.parametrize("shift", [0.0, 1e6])
@pytest.mark.parametrize("width", [1, 3, 32])
def test_closest_is_the_plain_minimum(width, shift):
    rng = np.random.default_rng(width)
    b = rng.normal(size=(700, width)) + shift
    b[300:600] = b[rng.integers(0, 300, 300)]  # equal rows: the first wins
    a = np.concatenate([rng.normal(size=(300, width)) + shift, b[500:600], b[:50] + 1e-9])
    gaps = sum((a[:, c, None] - b[None, :, c]) ** 2 for c in range(width))
    at, squared = neighbors.closest(a, b)
    assert (at == gaps.argmin(axis=1)).all() and (squared == gaps.min(axis=1)).all()
    a[0, 0] = np.nan
    assert neighbors.closest(a, b)[0][0] == 0


@pytest.mark.parametrize("width", [1, 2, 32])
def test_closest_sums_few_pairs(monkeypatch, width):
    """Only the pairs that could be nearest are summed dimension by dimension."""
    summed, plain = [], neighbors._squared
    monkeypatch.setattr(neighbors, "_squared", lambda a, b: (summed.append(plain(a, b)), summed[-1])[1])
    rng = np.random.default_rng(2)
    neighbors.closest(rng.normal(size=(2000, width)), rng.normal(size=(2048, width)))
    assert sum(g.size for g in summed) < 0.4 * 2000 * 2048


@pytest.mark.parametrize("block", [4, 1000])
def test_energy_distance_by_blocks(spark, table, conf, block):
    df, x, _ = table
    conf(BLOCK_ROWS_KEY, block)
    rows = df.select(F.lit("k").alias("k"), "entity", F.when(F.col("entity") < 13, "x").otherwise("y").alias("side"), F.col("x").alias("v"))
    a, b = x[:13], x[13:]
    d = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).mean()
    got = distances.energy_distance(rows, ["k"], "side", "entity", "v").first().energy_distance
    assert got == pytest.approx(2 * d(a, b) - d(a, a) - d(b, b), abs=1e-12)


def test_distances_of_a_sample(spark):
    rng = np.random.default_rng(0).normal(size=(20, 4))
    make = lambda shift: spark.createDataFrame(
        [("k", i + 100 * s, side, (rng[i] + (shift if s else 0)).tolist()) for s, side in enumerate("xy") for i in range(20)],
        "k string, entity int, side string, v array<double>",
    )
    dirs = distances.directions(spark, 10, 4, 1)
    lengths = [np.linalg.norm(r.weights) for r in dirs.collect()]
    np.testing.assert_allclose(lengths, 1.0)
    assert distances.energy_distance(make(0), ["k"], "side", "entity", "v").first().energy_distance == pytest.approx(0, abs=1e-12)
    assert distances.sliced_wasserstein(make(0), ["k"], "side", "v", dirs, 10).first().sliced_wasserstein == pytest.approx(0)
    assert distances.energy_distance(make(1), ["k"], "side", "entity", "v").first().energy_distance > 0
    assert distances.sliced_wasserstein(make(1), ["k"], "side", "v", dirs, 10).first().sliced_wasserstein > 0


def test_same_subspace_in_three_folds(spark):
    basis = np.eye(4)[:2]
    pca = spark.createDataFrame([(f, c + 1, basis[c].tolist()) for f in "abc" for c in range(2)], "model_fold string, component int, loading array<double>")
    got = linear.subspace_overlap(pca, 2, ["a", "b", "c"]).collect()
    assert len(got) == 3 and all(r.mean_squared_cosine == pytest.approx(1) for r in got)


def test_encoders(spark):
    train = spark.createDataFrame([("f", "lung", 0, 1), ("f", "skin", 1, 1), ("f", "lung", 0, 1)], "model_fold string, g string, a int, b int")
    coded = encoders.one_hot(
        spark.createDataFrame([("f", "skin"), ("f", "unknown")], "model_fold string, g string"),
        encoders.training_categories(train, ["model_fold"], "g"), ["model_fold"], "g",
    )
    assert {r.g: r.encoded for r in coded.collect()} == {"skin": [0, 1], "unknown": [0, 0]}
    assert [r.covariate for r in encoders.binary_scales(train, ["model_fold"], ["a", "b"]).collect()] == ["a"]


def test_distance_sums_of_two_blocks():
    rng = np.random.default_rng(4)
    for size, offset in ((1, 0.0), (3, 1e6), (64, 0.0), (64, 1e6)):
        a, b = rng.normal(size=(600, size)) + offset, rng.normal(size=(500, size)) + offset
        b[:50] = a[:50]
        want = np.sqrt(np.square(a[:, None] - b[None]).sum(axis=2)).sum()
        assert distances.distance_sum(a, b) == pytest.approx(want, rel=1e-12)
        assert distances.distance_sum(a[:1].repeat(300, 0), a[:1].repeat(7, 0)) == 0
