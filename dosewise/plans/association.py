"""Association tests gathered into adjusted families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import enrichment, resample
from dosewise.session import pinned


def registry(
    spearman: DataFrame, partial: DataFrame, binary: DataFrame, categorical: DataFrame, ids: list[str],
    seed: int | str, bootstraps: int = resample.BOOTSTRAPS, permutations: int = resample.PERMUTATIONS,
) -> DataFrame:
    """One pass per method over tall (test, ids, x, y [, z]) tables, one adjusted family.

    Tests without a p-value keep NULL and stay out of the family.
    """
    runs = {
        "spearman": resample.spearman_inference(spearman, ["test"], "x", "y", ids, seed, bootstraps, permutations),
        "partial_spearman": resample.partial_spearman_inference(partial, ["test"], "x", "y", "z", ids, seed, bootstraps, permutations),
        "cliffs_delta": resample.cliffs_delta_inference(binary, ["test"], "x", "y", ids, seed, bootstraps, permutations),
        "eta_squared": resample.eta_squared_inference(categorical, ["test"], "x", "y", ids, seed, permutations),
    }
    whole = None
    for family, result in runs.items():
        rows = result.withColumn("family", F.lit(family))
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    return enrichment.benjamini_hochberg(pinned(whole), [], "p_value", ["test"])


def target_table(rows: DataFrame, ids: list[str], seed: int | str, bootstraps: int = resample.BOOTSTRAPS,
                 permutations: int = resample.PERMUTATIONS) -> DataFrame:
    """Per target: mean response with interval, Spearman against x, adjusted over targets."""
    means = resample.bootstrap_mean(rows, ["test"], "y", ids, seed, bootstraps).select(
        "test", "mean", F.col("ci_low").alias("mean_low"), F.col("ci_high").alias("mean_high")
    )
    effects = resample.spearman_inference(rows, ["test"], "x", "y", ids, seed, bootstraps, permutations)
    return enrichment.benjamini_hochberg(pinned(means.join(effects, "test")), [], "p_value", ["test"])
