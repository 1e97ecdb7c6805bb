"""Descriptive tables: markers, periods, histograms, cases, error classes, conclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import ranking

# Quantile cuts, interval multiplier, histogram sizes.
HIGH_QUANTILE = 0.75
LOW_QUANTILE = 0.25
TRIM = (0.1, 0.9)
SEM_MULTIPLIER = 1.96
CASES = 5


def marker_summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median and fraction below zero."""
    base = values.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), S.fraction(F.col(value) < 0).alias("fraction_negative")
    )
    return base.join(ranking.quantiles(values, keys, value, {"median": 0.5}), keys)


def require_single(features: DataFrame, symbol: str, markers: list[str]) -> None:
    """Error unless each of the markers (a short fixed list) names exactly one feature row."""
    found = {r[symbol]: r["n"] for r in features.where(F.col(symbol).isin(*markers)).groupBy(symbol).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    wrong = {m: found.get(m, 0) for m in markers if found.get(m, 0) != 1}
    if wrong:
        raise ValueError(f"expected one row for each marker, found {wrong}")


def period_difference(values: DataFrame, key: str, hour: str, value: str) -> DataFrame:
    """Late mean minus early mean per key; middle hours are left out."""
    label = S.period(hour)
    mean = lambda p: F.avg(F.when(label == p, F.col(value))).alias(p)
    wide = values.groupBy(key).agg(mean("early"), mean("late"))
    return wide.withColumn("late_minus_early", F.col("late") - F.col("early"))


def mean_with_sem(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and 1.96 standard errors on both sides."""
    sem = S.ratio(F.stddev_samp(value), F.sqrt(F.count(value).cast("double")))
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), sem.alias("sem"), F.count(value).alias("n")).select(
        *keys, "mean", (F.col("mean") - SEM_MULTIPLIER * F.col("sem")).alias("low"),
        (F.col("mean") + SEM_MULTIPLIER * F.col("sem")).alias("high"), "n",
    )


def one_row(left: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a single aggregate row to every row (scalar join on a constant)."""
    return left.withColumn("_k", F.lit(1)).join(F.broadcast(row.limit(1).withColumn("_k", F.lit(1))), "_k").drop("_k")


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over min..max, last bin closed."""
    edges = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))
    placed = one_row(rows.where(F.col(value).isNotNull()), edges).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Square bins of (observed, predicted) with the log count."""
    edges = rows.agg(
        F.min(x).alias("_lx"), F.max(x).alias("_hx"), F.min(y).alias("_ly"), F.max(y).alias("_hy")
    )
    def place(v: str, lo: str, hi: str) -> Column:
        width = (F.col(hi) - F.col(lo)) / float(bins)
        return F.least(F.coalesce(F.floor(F.try_divide(F.col(v) - F.col(lo), width)), F.lit(0)), F.lit(bins - 1)).cast("int")

    return (
        one_row(rows, edges)
        .groupBy(place(x, "_lx", "_hx").alias("bin_x"), place(y, "_ly", "_hy").alias("bin_y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("log10_n", F.log10("n"))
    )


def variant_summary(rows: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_distinct(entity).alias("n_distinct"), F.min(value).alias("minimum"),
        F.max(value).alias("maximum"), F.avg(value).alias("mean"),
    )


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sd, min, quartiles, max per key."""
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), F.sum(value).cast("double").alias("total"),
    )
    return base.join(ranking.quantiles(rows, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys)


def error_classes(rows: DataFrame, error: str, magnitude: str, novelty: str, support: str) -> DataFrame:
    """Quantile flags and the first matching error type."""
    cuts: list[DataFrame] = []
    for name, column, q in (
        ("_qe", error, HIGH_QUANTILE), ("_qm", magnitude, HIGH_QUANTILE),
        ("_qn", novelty, HIGH_QUANTILE), ("_qs", support, LOW_QUANTILE),
    ):
        cuts.append(ranking.quantiles(rows, [], column, {name: q}))
    flagged = reduce(one_row, cuts, rows)
    flagged = (
        flagged.withColumn("high_error", F.col(error) >= F.col("_qe"))
        .withColumn("high_magnitude", F.col(magnitude) >= F.col("_qm"))
        .withColumn("high_novelty", F.col(novelty) >= F.col("_qn"))
        .withColumn("low_support", F.col(support) <= F.col("_qs"))
    )
    he = F.col("high_error")
    # Error type names, in order of precedence.
    types = [
        (he & F.col("high_magnitude"), "high_magnitude_target"),
        (he & F.col("high_novelty"), "baseline_novelty"),
        (he & F.col("low_support"), "low_cell_support"),
        (he, "mixed_unexplained"),
    ]
    return flagged.withColumn("error_type", S.first_match(types, "not_high_error")).drop("_qe", "_qm", "_qn", "_qs")


def trim_tails(rows: DataFrame, value: str, low: float = TRIM[0], high: float = TRIM[1]) -> DataFrame:
    """Rows between two quantiles, inclusive."""
    cuts = ranking.quantiles(rows, [], value, {"_lo": low, "_hi": high})
    return one_row(rows, cuts).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def prediction_cases(rows: DataFrame, error: str, ident: str, count: int = CASES) -> DataFrame:
    """Best, middle and worst cases by error."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    indexed = one_row(ranking.row_index(rows, [], [F.asc(error), F.asc(ident)], "_rn"), n)
    middle = F.floor(F.col("_n") / 2) + 1
    half = count // 2
    case = (
        F.when(F.col("_rn") <= count, "best")
        .when(F.col("_rn") > F.col("_n") - count, "worst")
        .when(F.col("_rn").between(middle - half, middle + (count - 1 - half)), "median")
    )
    return indexed.withColumn("case", case).where(F.col("case").isNotNull()).withColumnRenamed("_rn", "position").drop("_n")


def cohort_summary(rows: DataFrame, cohorts: dict[str, Column], entity: str, cells: str) -> DataFrame:
    """Entities and cells per differently filtered cohort, in one pass."""
    tagged = rows.withColumn(
        "cohort", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in cohorts.items()])))
    )
    return tagged.groupBy("cohort").agg(
        F.count_distinct(entity).alias("n_entities"), F.sum(cells).cast("bigint").alias("n_cells")
    )


def conclusions(metrics: DataFrame, metric: str = "rmse_gain_vs_b1") -> DataFrame:
    """Verdict per analysis from its gains, with evidence text.

    Sweeps are robust when every gain is positive; a single estimate is robust
    when its interval is above zero; noise analyses are a stated limitation.
    """
    rows = metrics.where(F.col("metric") == metric).groupBy("analysis").agg(
        F.min("estimate").alias("low"), F.max("estimate").alias("high"), F.min("ci95_low").alias("bound"),
        F.count_if(F.col("estimate") > 0).alias("positive"), F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"),
    )
    status = (
        F.when(F.col("kind") == "noise", "limitation")
        .when(F.col("kind") == "interval", F.when(F.col("bound") > 0, "robust").otherwise("inconclusive"))
        .otherwise(F.when(F.col("low") > 0, "robust").otherwise("sensitive"))
    )
    evidence = F.when(F.col("kind") == "repeat", F.format_string("positive repeats %d/%d", F.col("positive"), F.col("n"))).otherwise(
        F.format_string("gain range %.6f to %.6f", F.col("low"), F.col("high"))
    )
    return rows.select("analysis", status.alias("status"), evidence.alias("evidence"))
