"""Fixed-model evaluation of many data variants at once.

A variant (resample repeat, inclusion threshold, feature count) is a prefix of
the fold name, so every variant and fold is fitted in the same passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import folds, linear, resample
from dosewise.plans import benchmark
from dosewise.session import pinned

# Evaluation settings of the fixed model.
DIMENSION = 20
ALPHA = 100.0


def keyed_variants(rows: DataFrame, group: str, k: int, seed: int | str, shared_folds: bool = False) -> DataFrame:
    """Fold keys "variant|fold" for rows (variant, entity, group, x, y).

    Folds are dealt again inside every variant, or once over all entities when
    they must stay the same.
    """
    ids = rows.select("variant", "entity", group)
    n = ids.count()
    if shared_folds:
        dealt = folds.deal_folds(ids.select("entity", group).distinct(), "entity", group, k, seed, largest=n).select("entity", "fold")
        keyed = rows.join(dealt, "entity")
    else:
        dealt = folds.deal_folds(ids, "entity", group, k, seed, parents=["variant"], largest=n).select("variant", "entity", "fold")
        keyed = rows.join(dealt, ["variant", "entity"])
    name = F.concat_ws("|", "variant", "fold")
    return keyed.withColumn("test_of", F.array(name)).withColumn("held_of", F.array(name))


def fixed_outer_losses(
    rows: DataFrame, variants: list[str], k: int, dimension: int = DIMENSION, alpha: float = ALPHA,
    max_features: int | dict[str, int] | None = None, min_mean: float | None = None,
) -> DataFrame:
    """Held-out RMSE of the mean and the direct model per (variant, entity)."""
    names = [f"{v}|{f}" for v in variants for f in range(k)]
    fitted = benchmark.fit(rows, names, dimension, max_features=max_features, min_mean=min_mean)
    settings = [linear.Setting("mean", 0, alpha), linear.Setting("direct", dimension, alpha)]
    losses = benchmark.grid_losses(fitted, settings).withColumn("variant", F.split("model_fold", r"\|")[0])
    error = lambda s: F.max(F.when(F.col("setting") == s, F.col("rmse"))).alias(s)
    return losses.groupBy("variant", "entity").agg(error("mean"), error("direct"))


def variant_gains(losses: DataFrame, seed: int | str, count: int = resample.BOOTSTRAPS) -> DataFrame:
    """Gain of the direct model over the mean per variant, with interval."""
    return resample.paired_difference(pinned(losses), ["variant"], "mean", "direct", ["entity"], seed, count)


def inclusion_variants(rows: DataFrame, support: str, thresholds: tuple[int, ...]) -> DataFrame:
    """One variant per threshold, holding the entities with enough cells."""
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(support) >= t)
    return rows.withColumn("variant", F.explode(F.transform(passed, lambda t: t.cast("string"))))
