"""Latent shifts in control components and bootstrap intervals shared by features, against NumPy."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from dosewise.operators import distances, shared_bootstrap, summaries
from dosewise.queries import distance_queries as D
from dosewise.session import BROADCAST_BYTES_KEY

SF = "/root/testdata/sf0.001"


def gap(a, b):
    return np.linalg.norm(a[:, None] - b[None], axis=2).mean()


def wasserstein(a, b):
    at = np.sort(np.concatenate([a, b]))
    share = lambda s: np.searchsorted(np.sort(s), at[:-1], side="right") / len(s)
    return np.sum(np.abs(share(a) - share(b)) * np.diff(at))


def test_latent_shift_in_control_components(spark):
    got = entry.queries()["latent_shift_components"](spark, SF).toPandas().set_index(["label", "model"])
    pdf = D.samples(spark, SF).toPandas()
    v, control = np.stack(pdf.v), (pdf.side == "x").to_numpy()
    centre = v[control].mean(axis=0)
    axes = np.linalg.svd(v[control] - centre, full_matrices=False)[2][:D.COMPONENTS].T
    peaks = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    axes = axes * np.where(peaks < 0, -1, 1)
    dirs = np.stack(distances.directions(spark, D.DIRECTIONS, axes.shape[1], D.B.SEED).toPandas().weights)
    groups = {label: (v[control & (pdf.label == label)], v[~control & (pdf.label == label)]) for label in set(pdf.label)}
    groups = {k: (x, y) for k, (x, y) in groups.items() if len(x) and len(y)}
    deltas = {k: y.mean(axis=0) - x.mean(axis=0) for k, (x, y) in groups.items()}
    assert len(groups) > 1 and len(got) == 3 * len(groups)
    for label, (x, y) in groups.items():
        others = np.mean([d for k, d in deltas.items() if k != label], axis=0)
        for model, delta in (("NO_CHANGE", 0 * others), ("LABEL_MEAN", deltas[label]), ("OTHER_LABELS", others)):
            a, b = (x - centre) @ axes + delta @ axes, (y - centre) @ axes
            row = got.loc[(label, model)]
            assert (row.n_x, row.n_y) == (len(a), len(b))
            assert row.energy_distance == pytest.approx(max(2 * gap(a, b) - gap(a, a) - gap(b, b), 0), abs=2e-6)
            assert row.sliced_wasserstein == pytest.approx(np.mean([wasserstein(a @ d, b @ d) for d in dirs]), abs=2e-6)


def test_components_do_not_see_treated_rows(spark, conf):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6)) * [5, 4, 3, 1, 1, 1]
    make = lambda scale: spark.createDataFrame(
        [(i, "xy"[i % 2], (x[i] * (scale if i % 2 else 1)).tolist()) for i in range(30)], "entity int, side string, v array<double>"
    )
    one, two = (distances.control_components(make(s), "side", "entity", "v", 2, 4).toPandas() for s in (1, 1000))
    np.testing.assert_allclose(np.stack(one.loading), np.stack(two.loading), atol=1e-12)
    pca = distances.control_components(make(1), "side", "entity", "v", 2, 4)
    run = lambda: np.stack(distances.in_components(make(1), pca, "v", "entity", True).orderBy("entity").toPandas().v)
    whole = run()
    conf(BROADCAST_BYTES_KEY, 1)
    np.testing.assert_allclose(run(), whole, atol=1e-12)


@pytest.mark.parametrize("chunk,block", [(256, 2048), (2, 5)])
def test_intervals_of_shared_draws(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(shared_bootstrap, "CHUNK", chunk)
    monkeypatch.setattr(shared_bootstrap, "BLOCK", block)
    rng = np.random.default_rng(4)
    table = pd.DataFrame(rng.normal(size=(12, 5)), index=[f"e{i:02d}" for i in range(12)], columns=list("abcde"))
    table.loc["e03", "b"] = np.nan
    table.loc["e05":, "c"] = np.nan
    rows = [(e, f, float(table.loc[e, f])) for e in table.index for f in table.columns]
    rows += [(None, "a", 1.0), ("e01", None, 1.0), ("e02", "a", None), ("e04", "d", float("inf"))]
    df = spark.createDataFrame(rows, "line string, gene string, delta double")
    got = shared_bootstrap.feature_intervals(df, "gene", "line", "delta", 7, 40).toPandas().set_index("gene")
    counts = np.zeros((40, 12))
    for r in shared_bootstrap.draw_counts(spark, 12, 40, 7).collect():
        for d in r.draws:
            counts[d.rep, r.pos - 1] = d.times
    assert (counts.sum(axis=1) == 12).all()
    assert sorted(got.index) == list("abcde")
    for f in table.columns:
        v = table[f].to_numpy()
        given = ~np.isnan(v)
        weight = counts @ given
        means = (counts @ np.where(given, v, 0))[weight > 0] / weight[weight > 0]
        np.testing.assert_allclose(got.loc[f, ["ci_low", "ci_high"]].astype(float), np.quantile(means, [0.025, 0.975]), atol=1e-12)
    empty = spark.createDataFrame([], "line string, gene string, delta double")
    assert shared_bootstrap.feature_intervals(empty, "gene", "line", "delta", 7, 40).count() == 0


def test_markers_name_one_feature_each(spark):
    genes = spark.createDataFrame([("g1", "A"), ("g2", "B"), ("g3", "B"), ("g4", None)], "gene_id string, gene_symbol string")
    summaries.require_single(genes, "gene_symbol", ["A"])
    with pytest.raises(ValueError, match="'B': 2"):
        summaries.require_single(genes, "gene_symbol", ["A", "B"])
    with pytest.raises(ValueError, match="'C': 0"):
        summaries.require_single(genes, "gene_symbol", ["C"])


@pytest.mark.parametrize("entities,size", [(130, 50), (300, 300)])
def test_count_matrices_hold_all_draws_in_a_byte_each(spark, entities, size):
    count, found = 120, np.zeros((120, entities), np.int64)
    for r in shared_bootstrap.count_matrices(spark, entities, count, 7, size).collect():
        reps, at = min(count - r.first, shared_bootstrap.REPLICATES), r.block * size
        width = min(size, entities - at)
        assert len(r.times) == reps * width
        found[r.first : r.first + reps, at : at + width] += np.frombuffer(r.times, np.uint8).reshape(reps, width)
    expected = np.zeros_like(found)
    for r in shared_bootstrap.draw_counts(spark, entities, count, 7).collect():
        for d in r.draws:
            expected[d.rep, r.pos - 1] = d.times
    assert (found == expected).all() and (found.sum(axis=1) == entities).all()
