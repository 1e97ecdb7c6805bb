"""Training-fitted encoders for categories and 0/1 covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators.linear import MIN_SD


def training_categories(train: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Sorted distinct training categories per fold (a bounded vocabulary)."""
    return train.groupBy(*keys).agg(F.array_sort(F.collect_set(category)).alias("categories"))


def one_hot(rows: DataFrame, categories: DataFrame, keys: list[str], category: str, out: str = "encoded") -> DataFrame:
    """0/1 array over the training categories; an unseen category is all zeros."""
    return rows.join(categories, keys).withColumn(
        out, F.transform("categories", lambda c: (c == F.col(category)).cast("int"))
    )


def binary_scales(train: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Training mean and population SD per 0/1 column, tall; constant columns are dropped, other values are an error."""
    long = train.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "covariate", "value"
    )
    bad = F.count_if(~F.col("value").isin(0.0, 1.0))
    error = F.raise_error(F.concat(F.lit("values other than 0 and 1 in "), F.first("covariate"))).cast("double")
    stats = long.groupBy(*keys, "covariate").agg(
        F.when(bad == 0, F.avg("value")).otherwise(error).alias("mean"), F.stddev_pop("value").alias("sd"))
    return stats.where(F.col("sd") > MIN_SD)


def standardise(rows: DataFrame, scales: DataFrame, keys: list[str], id_column: str, columns: list[str]) -> DataFrame:
    """Tall standardised covariates (value - mean) / sd."""
    long = rows.select(*keys, id_column, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*keys, id_column], columns, "covariate", "value"
    )
    return long.join(scales, [*keys, "covariate"]).withColumn(
        "standardised", (F.col("value") - F.col("mean")) / F.col("sd")
    )
