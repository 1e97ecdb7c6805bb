"""Per-row evaluation of predictions, summaries and paired gains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import ranking


def signed_topk(rows: DataFrame, keys: list[str], observed: str, predicted: str, index: str, k: int) -> DataFrame:
    """Overlap of the k most negative and the k most positive features.

    Ascending stable order on both ends: upper ties prefer the higher index.
    A group is one vector, bounded by the feature dictionary; one of fewer than 2 k features is an error.
    """
    def rank(*order: Column) -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))

    marked = rows.select(
        *keys,
        rank(F.asc(observed), F.asc(index)).alias("_od"), rank(F.desc(observed), F.desc(index)).alias("_ou"),
        rank(F.asc(predicted), F.asc(index)).alias("_pd"), rank(F.desc(predicted), F.desc(index)).alias("_pu"),
    )
    return marked.groupBy(*keys).agg(_signed_overlap(k).alias("signed_topk_overlap"))


def _signed_overlap(k: int) -> Column:
    """Aggregate over the places _od, _ou, _pd, _pu of the features of one vector."""
    both = lambda a, b: F.count_if((F.col(a) <= k) & (F.col(b) <= k)) / float(k)
    return F.when(F.count(F.lit(1)) >= 2 * k, (both("_od", "_pd") + both("_ou", "_pu")) / 2.0).otherwise(
        F.raise_error(F.lit(f"a vector has fewer than {2 * k} features")).cast("double"))


def line_metrics(
    rows: DataFrame, keys: list[str], index: str = "feature", observed: str = "observed",
    predicted: str = "predicted", baseline: str = "baseline", k: int = 50, features: int = 100_000,
) -> DataFrame:
    """Eight metrics per key. `features` bounds the vector length.

    All windows and the final aggregate share one partitioning by `keys`.
    """
    ranked = ranking.average_rank(rows, keys, observed, "_ro", features)
    ranked = ranking.average_rank(ranked, keys, predicted, "_rp", features)
    part = Window.partitionBy(*keys)
    for name, order in {
        "_od": [F.asc(observed), F.asc(index)], "_ou": [F.desc(observed), F.desc(index)],
        "_pd": [F.asc(predicted), F.asc(index)], "_pu": [F.desc(predicted), F.desc(index)],
    }.items():
        ranked = ranked.withColumn(name, F.row_number().over(part.orderBy(*order)))

    measured = ranked.groupBy(*keys).agg(
        S.rmse(observed, predicted).alias("rmse_delta"),
        S.nrmse(observed, predicted).alias("nrmse_delta"),
        S.pearson(observed, predicted).alias("pcc_delta"),
        S.pearson("_ro", "_rp").alias("spearman_delta"),
        _signed_overlap(k).alias("signed_topk_overlap"),
        S.pearson(F.col(observed) - F.col(baseline), F.col(predicted) - F.col(baseline)).alias("pcc_context"),
        S.rmse(observed, baseline).alias("_base_rmse"),
        S.nrmse(observed, baseline).alias("_base_nrmse"),
    )
    return (
        measured.withColumn("rmse_gain_vs_b1", F.col("_base_rmse") - F.col("rmse_delta"))
        .withColumn("nrmse_gain_vs_b1", F.col("_base_nrmse") - F.col("nrmse_delta"))
        .drop("_base_rmse", "_base_nrmse")
    )


def tall(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        keys, metrics, "metric", "value"
    )


def macro_summary(tall_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Macro mean and n per (keys, metric); undefined values are left out."""
    return tall_rows.where(S.is_finite("value")).groupBy(*keys, "metric").agg(
        F.avg("value").alias("macro_mean"), F.count("value").alias("n")
    )


def wide(summary: DataFrame, keys: list[str], metrics: list[str], values: list[str]) -> DataFrame:
    """Tall summary -> one row per key, columns metric_value."""
    picks = [
        F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{m}_{v}") for m in metrics for v in values
    ]
    return summary.groupBy(*keys).agg(*picks)


def paired_gain(rows: DataFrame, key: str, metric: str, references: dict[str, str], model: str = "model") -> DataFrame:
    """reference error - model error per key, one column per reference model."""
    picks = [F.max(F.when(F.col(model) == m, F.col(metric))).alias(f"_ref_{n}") for n, m in references.items()]
    refs = rows.groupBy(key).agg(*picks)
    joined = rows.join(refs, key)
    gains = [(F.col(f"_ref_{n}") - F.col(metric)).alias(f"gain_vs_{n}") for n in references]
    return joined.select(key, model, metric, *gains)


def component_summary(scores: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    return scores.groupBy(*keys).agg(
        S.pearson(observed, predicted).alias("pearson"), S.rmse(observed, predicted).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def ordered_report(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Attach the fixed report position of each name."""
    return rows.withColumn("report_order", F.array_position(F.array(*[F.lit(n) for n in order]), F.col(name)))


def best_parameters(trace: DataFrame, keys: list[str], loss: str, ties: list[Column], params: list[str]) -> DataFrame:
    """Parameters of the lowest loss per key; ties resolved left to right."""
    order = F.struct(F.col(loss), *ties)
    best = F.min_by(F.struct(*[F.col(p) for p in params], F.col(loss)), order)
    return trace.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{p}").alias(p) for p in [*params, loss]])


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)
