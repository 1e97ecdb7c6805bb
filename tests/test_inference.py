import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.functions import hashes
from dosewise.operators import enrichment, replicates, resample, summaries


def test_bh_known_values(spark):
    df = spark.createDataFrame(list(enumerate([0.04, 0.001, 0.2, 0.01])) + [(9, None)], "i int, p double")
    got = {r.i: r.fdr_bh for r in enrichment.benjamini_hochberg(df, [], "p", ["i"]).collect()}
    assert got == {0: pytest.approx(0.04 * 4 / 3), 1: pytest.approx(0.004), 2: pytest.approx(0.2), 3: pytest.approx(0.02), 9: None}


@pytest.mark.parametrize("overlap,universe,size,top", [(3, 50, 10, 8), (0, 50, 10, 8), (8, 50, 10, 8), (5, 20, 15, 12), (40, 30_000, 900, 50)])
def test_hypergeometric_tail(spark, overlap, universe, size, top):
    exact = sum(math.comb(size, i) * math.comb(universe - size, top - i) for i in range(overlap, min(size, top) + 1) if top - i <= universe - size)
    exact /= math.comb(universe, top)
    df = spark.createDataFrame([(overlap, universe, size, top)], "o long, u long, s long, t long")
    got = df.select(enrichment.hypergeometric_tail(F.col("o"), F.col("u"), F.col("s"), F.col("t"))).first()[0]
    assert got == pytest.approx(1.0 if overlap == 0 else exact, rel=1e-8)


def test_cliffs_delta_sign(spark):
    rows = [("t", i, float(v), f) for i, (v, f) in enumerate([(5, True), (6, True), (7, True), (0, False), (1, False), (2, False)])]
    df = spark.createDataFrame(rows, "test string, id int, v double, f boolean")
    row = resample.cliffs_delta_inference(df, ["test"], "v", "f", ["id"], 1, 50, 99).first()
    assert row.effect == 1.0 and row.ci_low == 1.0 and 0 < row.p_value <= 1


def test_small_groups_have_no_effect(spark):
    df = spark.createDataFrame([("t", 1, 1.0, True), ("t", 2, 2.0, False), ("t", 3, 3.0, False)], "test string, id int, v double, f boolean")
    row = resample.cliffs_delta_inference(df, ["test"], "v", "f", ["id"], 1, 10, 10).first()
    assert row.effect is None and row.p_value is None
    pairs = df.withColumn("x", F.col("v"))
    assert resample.spearman_inference(pairs, ["test"], "x", "v", ["id"], 1, 10, 10).first().effect is None


def test_spearman_of_a_monotone_pair(spark):
    df = spark.createDataFrame([("t", i, float(i), float(i ** 3)) for i in range(20)], "test string, id int, x double, y double")
    row = resample.spearman_inference(df, ["test"], "x", "y", ["id"], 3, 40, 99).first()
    assert row.effect == pytest.approx(1.0) and row.ci_low == pytest.approx(1.0) and row.p_value == pytest.approx(0.01)


def test_partial_spearman_equals_closed_form(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=30)
    x, y = z + rng.normal(size=30), z + rng.normal(size=30)
    df = spark.createDataFrame([("t", i, float(x[i]), float(y[i]), float(z[i])) for i in range(30)], "test string, id int, x double, y double, z double")
    row = resample.partial_spearman_inference(df, ["test"], "x", "y", "z", ["id"], 3, 20, 49).first()
    r = lambda a, b: np.corrcoef(a.argsort().argsort(), b.argsort().argsort())[0, 1]
    xy, xz, yz = r(x, y), r(x, z), r(y, z)
    assert row.effect == pytest.approx((xy - xz * yz) / math.sqrt((1 - xz ** 2) * (1 - yz ** 2)))


def test_eta_squared(spark):
    df = spark.createDataFrame([("t", i, float(i // 5), i // 5) for i in range(15)] + [("flat", i, 1.0, i % 2) for i in range(6)], "test string, id int, v double, g int")
    got = {r.test: r for r in resample.eta_squared_inference(df, ["test"], "v", "g", ["id"], 2, 99).collect()}
    assert got["t"].effect == pytest.approx(1.0) and got["t"].p_value == pytest.approx(0.01)
    assert got["flat"].effect is None and got["flat"].p_value is None


def test_bootstrap_interval_and_missing_values(spark):
    df = spark.createDataFrame([("t", i, float(i)) for i in range(50)] + [("t", 99, float("nan")), ("c", 1, 2.0)], "test string, id int, v double")
    got = {r.test: r for r in resample.bootstrap_mean(df, ["test"], "v", ["id"], 1, 200).collect()}
    assert got["t"].mean == pytest.approx(24.5) and got["t"].n == 50
    assert got["t"].ci_low < 24.5 < got["t"].ci_high
    assert (got["c"].ci_low, got["c"].ci_high) == (2.0, 2.0)


def test_sampling_and_halves(spark):
    cells = spark.createDataFrame([(g, i) for g in "ab" for i in range(11)], "g string, cell int")
    first = resample.sample_cells(cells, ["g"], ["cell"], 5, 7, 2)
    again = resample.sample_cells(cells, ["g"], ["cell"], 5, 7, 2)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted(map(tuple, again.collect())) and len(set(rows)) == 20
    halves = resample.split_halves(cells, ["g"], ["cell"], 7, 1).toPandas()
    assert halves.groupby(["g", "half"]).size().tolist() == [5, 5, 5, 5]
    assert resample.undersized(cells, ["g"], 12).count() == 2
    with pytest.raises(ValueError):
        resample.sample_cells(cells, ["g"], ["cell"], 12, 1, 1)


def test_repeats_of_cells_are_not_shuffled(spark, conf):
    cells = spark.createDataFrame([(g, i) for g in "ab" for i in range(11)], "g string, cell int")
    make = lambda: (resample.sample_cells(cells, ["g"], ["cell"], 5, 7, 3), resample.split_halves(cells, ["g"], ["cell"], 7, 3))
    together = make()
    for df in together:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g" in plan and "hashpartitioning(repeat" not in plan
    conf("spark.dosewise.windowRows", 20)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    for one, other in zip(together, make(), strict=True):
        assert rows(one) == rows(other)


def test_error_types_follow_precedence(spark):
    rows = [(i, float(i), float(i), float(100 - i), i) for i in range(20)]
    df = spark.createDataFrame(rows, "entity int, e double, m double, n double, s int")
    got = {r.entity: r.error_type for r in summaries.error_classes(df, "e", "m", "n", "s").collect()}
    assert got[19] == "high_magnitude_target" and got[0] == "not_high_error"


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    got = {r.bin: r.n for r in summaries.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [(r.bin, r.n) for r in summaries.histogram(flat, "v", 5).collect()] == [(0, 2)]


def test_bootstrap_inside_rows_equals_joined_rows(spark, conf):
    rows = spark.createDataFrame([("a" if i % 3 else None, i, float(i % 7)) for i in range(60)], "k string, i int, v double")
    run = lambda: sorted(map(str, resample.bootstrap_mean(rows, ["k"], "v", ["i"], 7, 50).collect()))
    inside = run()
    conf(resample.PACKED_ROWS_KEY, 5)
    assert run() == inside and len(inside) == 2


@pytest.mark.parametrize("run", ["spearman", "partial", "cliffs", "eta"])
def test_packed_rank_tests_equal_shuffled_rows(spark, conf, run):
    """Blocks of replicates against one row per draw: ties, tests of several sizes, null keys."""
    rng = np.random.default_rng(8)
    sizes = {"a": 23, "b": 23, None: 40, "few": 3}
    rows = [(k, i, float(rng.integers(0, 9)), float(rng.normal()), float(rng.integers(0, 5)), bool(rng.integers(0, 2)), f"g{rng.integers(0, 3)}") for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double, z double, f boolean, g string").where("k is not null")

    def result():
        found = {
            "spearman": lambda: resample.spearman_inference(df, ["k"], "x", "y", ["i"], 5, 60, 80),
            "partial": lambda: resample.partial_spearman_inference(df, ["k"], "x", "y", "z", ["i"], 5, 60, 80),
            "cliffs": lambda: resample.cliffs_delta_inference(df, ["k"], "x", "f", ["i"], 5, 60, 80),
            "eta": lambda: resample.eta_squared_inference(df, ["k"], "y", "g", ["i"], 5, 80),
        }[run]()
        return {r.k: [v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-9) for v in r] for r in found.collect()}

    packed = result()
    conf(resample.RANKED_ROWS_KEY, 2)
    assert result() == {k: [getattr(v, "expected", v) for v in r] for k, r in packed.items()} and len(packed) == 3


def test_hashes_of_many_texts():
    for seed, first, last, n in [("5p", 8, 12, 1234), ("7", 95, 105, 9), ("52711", 999, 1001, 20_001), ("x" * 47, 0, 3, 12), ("7", 0, 2, 1)]:
        one = lambda r, p: int(hashlib.md5(f"{seed}|{r}|{p}".encode()).hexdigest()[:15], 16)
        expected = [[one(r, p) for p in range(1, n + 1)] for r in range(first, last)]
        assert hashes.order_numbers([f"{seed}|{r}" for r in range(first, last)], n).tolist() == expected


def test_random_order_with_equal_and_close_numbers():
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 1 << 60, (3, 300))
    close = (rng.integers(0, 40, (3, 300)) << 40) + rng.integers(0, 8, (3, 300))
    for numbers in (wide, close, wide[:, :1]):
        assert replicates.random_order(numbers).tolist() == np.argsort(numbers, axis=1, kind="stable").tolist()


@pytest.mark.parametrize("run", ["cliffs", "eta", "mean"])
def test_large_groups_shuffle_no_draws(spark, monkeypatch, run):
    """A group of 250,000 rows: no row for each draw, the effect of the whole group."""
    def refuse(*_, **__):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(resample, "bootstrap_rows", refuse)
    monkeypatch.setattr(resample, "permuted", refuse)
    n = 250_000
    df = spark.range(n).select(F.lit("t").alias("k"), "id", (F.col("id") % 1000).cast("double").alias("v"), (F.col("id") % 1000 >= 400).alias("f"))
    if run == "cliffs":
        row = resample.cliffs_delta_inference(df, ["k"], "v", "f", ["id"], 1, 4, 9).first()
        assert (row.effect, row.ci_low, row.n, row.p_value) == (1.0, 1.0, n, 0.1)
    elif run == "eta":
        row = resample.eta_squared_inference(df, ["k"], "v", "f", ["id"], 1, 9).first()
        v, f = np.arange(1000.0), np.arange(1000) >= 400
        between = 400 * (v[~f].mean() - v.mean()) ** 2 + 600 * (v[f].mean() - v.mean()) ** 2
        assert row.effect == pytest.approx(between / (1000 * v.var())) and (row.n, row.p_value) == (n, 0.1)
    else:
        row = resample.bootstrap_mean(df, ["k"], "v", ["id"], 1, 6).first()
        drawn = hashes.order_numbers([f"1|{r}" for r in range(6)], n) % n
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"1|{i}".encode()).hexdigest(), i))
        means = (np.array(order) % 1000)[drawn].mean(axis=1)
        assert (row.ci_low, row.ci_high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
