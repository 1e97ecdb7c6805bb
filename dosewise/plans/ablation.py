"""Fixed model variants, evaluated side by side with nothing chosen on test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators.linear import Setting
from dosewise.plans import benchmark

# Base variant and the dimensions and ranks that are varied.
BASE_DIMENSION = 20
BASE_RANK = 20
ALPHA = 100.0
DIMENSIONS = (5, 10, 30)
RANKS = (2, 5, 10, 30, 40, 50)


def fixed_variants(groups: int = 0, covariates: int = 0, widest: int | None = None) -> list[Setting]:
    """Full model, varied dimension, varied rank, and added covariates.

    Extra columns hold `groups` category indicators followed by `covariates`
    0/1 values; `widest` drops variants the data cannot support.
    """
    variants = [Setting(f"FULL_D{BASE_DIMENSION}_R{BASE_RANK}", BASE_DIMENSION, ALPHA, BASE_RANK)]
    variants += [Setting(f"CONTROL_D{d:02d}_R{BASE_RANK}", d, ALPHA, BASE_RANK) for d in DIMENSIONS]
    variants += [Setting(f"RANK_D{BASE_DIMENSION}_R{r:02d}", BASE_DIMENSION, ALPHA, r) for r in RANKS]
    if groups:
        variants.append(Setting("GROUP_D20_R20", BASE_DIMENSION, ALPHA, BASE_RANK, tuple(range(groups))))
    if covariates:
        variants.append(
            Setting("COVARIATE_D20_R20", BASE_DIMENSION, ALPHA, BASE_RANK, tuple(range(groups, groups + covariates)))
        )
    if widest is not None:
        variants = [v for v in variants if max(v.dimension, v.rank) <= widest]
    return variants


def complexity(variants: DataFrame, targets: int) -> DataFrame:
    """Parameter counts: direct ridge when rank is 0, low-rank otherwise."""
    count = F.when(F.col("rank") == 0, S.ridge_parameter_count("dimension", F.lit(targets))).otherwise(
        S.low_rank_parameter_count("dimension", "rank", F.lit(targets))
    )
    return variants.withColumn("parameter_count", count.cast("bigint"))


def variant_losses(fitted: benchmark.Fitted, variants: list[Setting], extra: str | None = None) -> DataFrame:
    """Per-entity RMSE of every variant on every outer test row."""
    from dosewise.operators import linear

    return linear.fold_predictions(
        fitted.rows, fitted.models(), variants, fitted.folds, fitted.components, extra=extra, losses=True
    )
