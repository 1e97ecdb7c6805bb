"""Annotation builds, final tables, keyed replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import contracts as C


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first row per key in an explicit order."""
    rest = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*rest), F.col(order))
    return rows.groupBy(key).agg(first.alias("_r")).select(key, "_r.*")


def annotate(base: DataFrame, annotation: DataFrame, key: str, order: str, fills: dict) -> DataFrame:
    """Left join on a deduplicated key with filled nulls."""
    joined = base.join(first_per_key(annotation, key, order), key, "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c) for c in joined.columns]
    )


def join_chain(base: DataFrame, others: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Successive inner joins; join strategy is left to the optimiser."""
    return reduce(lambda df, o: df.join(o[0], o[1]), others, base)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which no key may repeat on either side."""
    C.require(C.report([C.unique_key(left, keys, "unique_left"), C.unique_key(right, keys, "unique_right")]))
    return left.join(right, keys)


def replace_by_key(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored rows with the same key; the rest stay."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def scoped_union(parts: dict[str, DataFrame], scope: str = "evaluation_scope") -> DataFrame:
    frames = [df.withColumn(scope, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def metric_sections(sections: list[tuple[str, DataFrame, list[str], dict[str, str]]]) -> DataFrame:
    """Wide summaries -> one tall table: (section, keys..., metric, value) with relabelled models."""
    tall = []
    for name, df, metrics, relabel in sections:
        rows = df.select("model", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
            ["model"], metrics, "metric", "value"
        )
        labels = F.col("model")
        for old, new in relabel.items():
            labels = F.when(F.col("model") == old, F.lit(new)).otherwise(labels)
        tall.append(rows.select(F.lit(name).alias("section"), labels.alias("model"), "metric", "value"))
    return reduce(DataFrame.unionByName, tall)
