"""Layout converters, feature statistics and mean predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.operators import contracts as C
from dosewise.operators import ranking

# Expression floor, variance floor, minimum group support.
MIN_MEAN = 0.1
MIN_VARIANCE = 1e-10
MIN_GROUP = 2
TIE_DIGITS = 9


def to_long(vectors: DataFrame, keys: list[str], vector: str, index: str = "feature", value: str = "value") -> DataFrame:
    """Array rows -> one row per element, 0-based index."""
    return vectors.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias(index, value))


def to_array(long: DataFrame, keys: list[str], index: str, value: str, out: str = "vector") -> DataFrame:
    """Long rows -> float array in index order (a group is one vector)."""
    packed = F.array_sort(F.collect_list(F.struct(index, value)))
    return long.groupBy(*keys).agg(F.transform(packed, lambda e: e[value].cast("float")).alias(out))


def aligned(rows: DataFrame, wanted: DataFrame, key: str, complete: bool = False) -> DataFrame:
    """Rows for the requested keys, carrying the requested position.

    With `complete`, a repeated or missing key is an error; else a missing row is null.
    """
    if complete:
        C.require(C.report([
            C.unique_key(rows.join(wanted.select(key).distinct(), key, "left_semi"), [key], "unique_rows"), C.unique_key(wanted, [key], "unique_wanted"),
            C.expected_count(wanted.join(rows, key, "left_anti"), 0, "missing_rows"),
        ]))
    return wanted.join(rows, key, "left")


def train_rows(values: DataFrame, members: DataFrame, entity: str = "entity") -> DataFrame:
    """Values of training entities per model fold."""
    return values.join(members.where(F.col("role") == "train").select("model_fold", entity), entity)


def feature_stats(values: DataFrame, keys: list[str], feature: str, value: str) -> DataFrame:
    """Mean and population variance per feature."""
    return values.groupBy(*keys, feature).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(value).alias("n")
    )


def sparse_feature_stats(values: DataFrame, keys: list[str], feature: str, value: str, n: str | Column) -> DataFrame:
    """The same with implicit zeros: n is the number of vectors including absent entries."""
    count = F.col(n) if isinstance(n, str) else n
    sums = values.groupBy(*keys, feature).agg(
        F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.max(count).alias("n")
    )
    mean = F.col("_s") / F.col("n")
    return sums.select(
        *keys, feature, mean.alias("mean"),
        F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"), "n",
    )


def variable_features(
    stats: DataFrame, keys: list[str], feature: str, n: int, min_mean: float = MIN_MEAN,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Top n features by variance after the mean and variance floors; ties by feature.

    Variances are compared at TIE_DIGITS, so equal features stay tied whatever
    order their rows were summed in.
    """
    kept = stats.where((F.col("mean") >= min_mean) & (F.col("variance") > MIN_VARIANCE))
    if candidates is not None:
        kept = kept.join(candidates, feature, "left_semi")
    return ranking.top_rows(kept, keys, [F.desc(F.round("variance", TIE_DIGITS)), F.asc(feature)], n, out="rank")


def global_mean(values: DataFrame, keys: list[str], feature: str, value: str) -> DataFrame:
    return values.groupBy(*keys, feature).agg(F.avg(value).alias("global_mean"))


def group_mean_with_fallback(
    train: DataFrame, test: DataFrame, keys: list[str], group: str, feature: str, value: str,
    minimum: int = MIN_GROUP,
) -> DataFrame:
    """Group mean for each test row, or the global mean when the group is too small."""
    grouped = train.groupBy(*keys, group, feature).agg(F.avg(value).alias("group_mean"), F.count(value).alias("_n"))
    base = global_mean(train, keys, feature, value)
    wanted = test.join(base, keys) if keys else test.join(base)
    joined = wanted.join(grouped, [*keys, group, feature], "left")
    enough = F.coalesce(F.col("_n") >= minimum, F.lit(False))
    return joined.select(
        *test.columns, feature,
        F.when(enough, F.col("group_mean")).otherwise(F.col("global_mean")).alias("predicted"),
        (~enough).alias("fallback"),
    )


def dispersion(values: DataFrame, keys: list[str], feature: str, value: str) -> DataFrame:
    """RMS over features of the sample SD across entities."""
    spread = values.groupBy(*keys, feature).agg(F.var_samp(value).alias("_v"))
    return spread.groupBy(*keys).agg(F.sqrt(F.avg("_v")).alias("dispersion"), F.count("_v").alias("n_features"))


def magnitude(values: DataFrame, entity_keys: list[str], mean_keys: list[str], feature: str, value: str) -> DataFrame:
    """Per row: RMS of the vector and RMSE to the mean vector of its group."""
    means = values.groupBy(*mean_keys, feature).agg(F.avg(value).alias("_m"))
    joined = values.join(means, [*mean_keys, feature])
    keys = list(dict.fromkeys([*entity_keys, *mean_keys]))
    return joined.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(value, 2))).alias("response_rms"),
        F.sqrt(F.avg(F.pow(F.col(value) - F.col("_m"), 2))).alias("rmse_to_mean"),
    )


def display_groups(rows: DataFrame, group: str, minimum: int = 4, other: str = "other / rare") -> DataFrame:
    """Lump categories with few rows; sizes come from an aggregate, not a window over rows."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return (
        rows.join(sizes, group)
        .withColumn("display_group", F.when(F.col("_n") < minimum, other).otherwise(F.col(group)))
        .drop("_n")
    )


def representative(rows: DataFrame, order: list[Column], largest: int | None = None) -> DataFrame:
    """The row at position n div 2 of a total order."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    indexed = ranking.row_index(rows, [], order, "_rn", largest)
    return indexed.join(n, F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")
