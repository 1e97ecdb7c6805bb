"""Balanced, lineage-spreading folds and the leakage-safe membership table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions import draws
from dosewise.operators import ranking


def deal_folds(
    entities: DataFrame, entity: str, group: str, k: int, seed: int | str,
    parents: list[str] | None = None, out: str = "fold", largest: int | None = None,
) -> DataFrame:
    """Deal entities to k folds like cards, group after group, larger groups first.

    Fold sizes differ by at most one, and so do the counts of each group across
    folds. Each group starts where the previous one stopped. `largest` is a
    known bound on the entities per parent; without it group sizes are counted.
    """
    parents = parents or []
    if k < 2:
        raise ValueError("at least two folds are needed")
    facts = entities.groupBy(*parents, entity).count().groupBy(*parents).agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("n"))
    if not facts.where((F.col("most") > 1) | (F.col("n") < k)).isEmpty():
        raise ValueError(f"entities must be distinct and at least {k}")
    sizes = entities.groupBy(*parents, group).agg(F.count(F.lit(1)).alias("_n"))
    upto = ranking.running(sizes, parents, [F.desc("_n"), F.asc(group)], sums={"_upto": "_n"}, largest=largest)
    starts = upto.select(*parents, group, (F.col("_upto") - F.col("_n")).alias("_start"))
    shuffled = ranking.hash_rank(
        entities, [*parents, group], draws.order_hash(seed, *parents, entity), [entity], largest=largest
    )
    return (
        ranking.join_null_safe(shuffled, starts, [*parents, group])
        .withColumn(out, ((F.col("_start") + F.col("rn") - 1) % k).cast("int"))
        .drop("_start", "rn")
    )


def inner_folds(
    outer: DataFrame, entity: str, group: str, k_outer: int, k_inner: int, seed: int | str, largest: int | None = None
) -> DataFrame:
    """Folds of every outer training set: one row per (outer_fold, training entity)."""
    training = (
        outer.withColumnRenamed("fold", "own_fold")
        .withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1))))
        .where(F.col("outer_fold") != F.col("own_fold"))
    )
    return deal_folds(training, entity, group, k_inner, seed, parents=["outer_fold"], out="inner_fold", largest=largest).drop("own_fold")


def membership(outer: DataFrame, entity: str, fold: str, k: int) -> DataFrame:
    """(model_fold, entity, role) with one row per fold and entity."""
    return outer.select(
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("model_fold"), entity, F.col(fold).alias("_own")
    ).select(
        "model_fold", entity,
        F.when(F.col("_own") == F.col("model_fold"), "test").otherwise("train").alias("role"),
    )


def held_out_keys(outer: DataFrame, inner: DataFrame | None, entity: str, k_inner: int = 0) -> DataFrame:
    """Per entity: model folds it is evaluated in, and model folds that must not fit on it.

    Fits use (sum over all rows) - (sum over held-out rows), so each entity is
    listed only where it is left out instead of where it trains.
    Model folds are named "outer" or "outer/inner".
    """
    own = F.col("fold").cast("string")
    base = outer.select(entity, own.alias("_own"))
    if inner is None:
        return base.select(entity, F.array("_own").alias("test_of"), F.array("_own").alias("held_of"))
    inside = inner.groupBy(entity).agg(
        F.sort_array(F.collect_list(F.concat_ws("/", "outer_fold", "inner_fold"))).alias("_in")
    )
    shut = F.transform(
        F.sequence(F.lit(0), F.lit(k_inner - 1)), lambda i: F.concat_ws("/", F.col("_own"), i.cast("string"))
    )
    joined = base.join(inside, entity)
    tested = F.concat(F.array("_own"), F.col("_in"))
    return joined.select(entity, tested.alias("test_of"), F.concat(tested, shut).alias("held_of"))


def leave_one_group_out(entities: DataFrame, entity: str, group: str) -> DataFrame:
    """Every group is a fold of its own."""
    name = F.col(group).cast("string")
    return entities.select(entity, F.array(name).alias("test_of"), F.array(name).alias("held_of"))


def fold_balance(assigned: DataFrame, entity: str, fold: str, k: int) -> DataFrame:
    """One row of balance facts for contract checks."""
    sizes = assigned.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("d"))
    return sizes.agg(
        F.count(F.lit(1)).alias("folds"),
        (F.max("n") - F.min("n")).alias("size_spread"),
        F.sum("n").alias("rows"), F.sum("d").alias("entities"),
        F.bool_and(F.col(fold).between(0, k - 1)).alias("ids_in_range"),
    ).withColumn(
        "balanced",
        (F.col("folds") == k) & (F.col("size_spread") <= 1)
        & (F.col("rows") == F.col("entities")) & F.col("ids_in_range"),
    )
