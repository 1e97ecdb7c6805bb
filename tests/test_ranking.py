import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.functions.draws import order_hash
from dosewise.operators import distances, enrichment, ranking
from dosewise.session import WINDOW_ROWS_KEY


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(1)
    data = [("hot" if i % 3 else f"k{i % 5}", i, float(rng.integers(0, 40))) for i in range(400)]
    data += [(None, i, None if i % 4 == 0 else float(i % 9)) for i in range(400, 440)] + [("hot", i, None) for i in range(440, 450)]
    return spark.createDataFrame(data, "k string, i int, v double").repartition(5)


def same(a, b, keys):
    return a.toPandas().sort_values(keys).reset_index(drop=True).equals(b.toPandas().sort_values(keys).reset_index(drop=True)[list(a.columns)])


OPERATIONS = {
    "row_index": lambda df: ranking.row_index(df, ["k"], [F.desc("v"), F.asc("i")]),
    "average_rank": lambda df: ranking.average_rank(df, ["k"], "v", "r").select("k", "i", "v", "r"),
    "quantiles": lambda df: ranking.quantiles(df, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.95}),
    "quantiles_all": lambda df: ranking.quantiles(df, [], "v", {"a": 0.1, "m": 0.5}),
    "hash_rank": lambda df: ranking.hash_rank(df, ["k"], order_hash(7, "i"), ["i"], "rn", "n"),
    "bh": lambda df: enrichment.benjamini_hochberg(df.withColumn("p", F.col("v") / 40), ["k"], "p", ["i"]),
    "bh_all": lambda df: enrichment.benjamini_hochberg(df.withColumn("p", F.col("v") / 40), [], "p", ["i"]),
    "wasserstein": lambda df: distances.wasserstein_1d(
        df.withColumn("side", F.when(F.col("i") % 2 == 0, "x").otherwise("y")), ["k"], "side", "v"
    ).select("k", F.round("wasserstein", 9).alias("w")),
}


def test_p_values_outside_their_range_are_refused(rows):
    with pytest.raises(ValueError):
        enrichment.benjamini_hochberg(rows.withColumn("p", F.col("v")), ["k"], "p", ["i"])


@pytest.mark.parametrize("name", OPERATIONS)
@pytest.mark.parametrize("limit", [1, 7])
def test_split_groups_equal_plain_windows(rows, conf, name, limit):
    plain = OPERATIONS[name](rows)
    expected = plain.toPandas()
    conf(WINDOW_ROWS_KEY, limit)
    got = OPERATIONS[name](rows).toPandas()
    keys = [c for c in ("k", "i") if c in expected]
    if keys:
        expected, got = expected.sort_values(keys), got.sort_values(keys)
    for c in expected.columns:
        if expected[c].dtype == object:
            assert list(expected[c]) == list(got[c])
        else:
            np.testing.assert_allclose(expected[c].to_numpy(dtype=float), got[c].to_numpy(dtype=float), rtol=0, atol=1e-12)


def test_quantiles_match_numpy(rows):
    pdf = rows.toPandas().dropna()
    got = ranking.quantiles(rows, ["k"], "v", {"q": 0.25}).toPandas().set_index("k")["q"]
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(g["v"], 0.25))


def test_top_rows_limit_reaches_map_side(rows):
    plan = ranking.top_rows(rows, ["k"], [F.desc("v"), F.asc("i")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
