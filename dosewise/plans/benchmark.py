"""Nested cross-validation and held-out prediction, all folds in shared passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import folds, linear, metrics, neighbors, vectors
from dosewise.session import pinned


@dataclass(frozen=True)
class Grid:
    dimensions: tuple[int, ...] = (2, 5, 10, 20)
    alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
    ranks: tuple[int, ...] = (2, 5, 10, 20)

    def direct(self) -> list[linear.Setting]:
        return [linear.Setting("direct", d, a) for d in self.dimensions for a in self.alphas]

    def low_rank(self) -> list[linear.Setting]:
        return [
            linear.Setting("low_rank", d, a, r) for d in self.dimensions for r in self.ranks for a in self.alphas
        ]


@dataclass
class Fitted:
    """Rows with fold keys plus the fitted model tables of every fold."""
    rows: DataFrame
    folds: list[str]
    control: DataFrame
    response: DataFrame | None
    moments: DataFrame
    components: int

    def models(self) -> DataFrame:
        return linear.fold_models(self.control, self.moments, self.response)


def feasible(candidates: tuple[int, ...], available: int) -> tuple[int, ...]:
    """Unique positive candidates that fit; none left is an error."""
    kept = tuple(sorted({c for c in candidates if 0 < c <= available}))
    if not kept:
        raise ValueError("no feasible dimension")
    return kept


def nested_rows(vectors_table: DataFrame, entity: str, group: str, k_outer: int, k_inner: int, seed: int | str):
    """Attach outer and inner fold keys; returns (rows, fold names, outer table, inner table)."""
    ids = vectors_table.select(entity, group)
    n = ids.count()
    # md5 dealing gives the same folds however often it is evaluated
    outer = folds.deal_folds(ids, entity, group, k_outer, seed, largest=n)
    inner = folds.inner_folds(outer, entity, group, k_outer, k_inner, seed, largest=n)
    keyed = vectors_table.join(folds.held_out_keys(outer, inner, entity, k_inner), entity)
    names = [str(o) for o in range(k_outer)] + [f"{o}/{i}" for o in range(k_outer) for i in range(k_inner)]
    return pinned(keyed), names, outer, inner


def outer_rows(vectors_table: DataFrame, entity: str, group: str, k: int, seed: int | str):
    """The same without inner folds; returns (rows, fold names)."""
    ids = vectors_table.select(entity, group)
    outer = folds.deal_folds(ids, entity, group, k, seed, largest=ids.count())
    keyed = vectors_table.join(folds.held_out_keys(outer, None, entity), entity)
    return pinned(keyed), [str(o) for o in range(k)]


def fit(
    rows: DataFrame, names: list[str], components: int, ranks: int = 0, max_features: int | dict[str, int] | None = None,
    min_mean: float | None = None, extra: str | None = None, scaled: int = 0, panel: list[int] | None = None,
) -> Fitted:
    """Control PCA, ridge moments and (optionally) response PCA of every fold."""
    control = pinned(linear.fit_pca(rows, "x", names, components, max_features, min_mean, panel))
    moments = pinned(linear.ridge_moments(rows, control, names, extra=extra, scaled=scaled))
    response = pinned(linear.fit_pca(rows, "y", names, ranks)) if ranks else None
    return Fitted(rows, names, control, response, moments, components)


def grid_losses(fitted: Fitted, settings: list[linear.Setting]) -> DataFrame:
    """RMSE of every (fold, held-out entity, setting)."""
    return linear.fold_predictions(
        fitted.rows, fitted.models(), settings, fitted.folds, fitted.components, losses=True
    )


def neighbor_losses(fitted: Fitted, dimensions: tuple[int, ...]) -> DataFrame:
    """RMSE of copying the nearest training row's response, per fold and dimension count."""
    found = nearest_rows(fitted, dimensions)
    answers = fitted.rows.select("entity", "y")
    copied = answers.select(F.col("entity").alias("neighbor"), F.col("y").alias("copied"))
    gap = F.zip_with("y", "copied", lambda a, b: (a - b) * (a - b))
    mean = F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v) / F.size("y")
    return found.join(answers, "entity").join(copied, "neighbor").select(
        "model_fold", "entity", F.lit("nearest").alias("setting"), "dimension",
        F.lit(0).alias("rank"), F.lit(0.0).alias("alpha"), F.sqrt(mean).alias("rmse"), "neighbor",
    )


def nearest_rows(fitted: Fitted, dimensions: tuple[int, ...]) -> DataFrame:
    z = pinned(linear.scores(fitted.rows, fitted.control, "x", fitted.folds, whiten=True))
    return neighbors.nearest(
        z.where("role = 'test'"), z.where("role = 'train'"), ["model_fold"], "z", list(dimensions)
    )


def select_settings(losses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace, chosen) from inner-fold losses: per-entity losses are pooled over inner folds.

    Ties: lower rank, lower dimension, then the lower alpha for direct models
    and the higher alpha for low-rank ones.
    """
    inner = losses.where(F.col("model_fold").contains("/")).withColumn("outer_fold", F.split("model_fold", "/")[0])
    trace = inner.groupBy("model_fold", "setting", "dimension", "rank", "alpha").agg(
        F.avg("rmse").alias("mean_rmse"), F.count("rmse").alias("n_validation")
    )
    pooled = inner.groupBy("outer_fold", "setting", "dimension", "rank", "alpha").agg(F.avg("rmse").alias("loss"))
    tie = F.when(F.col("setting") == "low_rank", -F.col("alpha")).otherwise(F.col("alpha"))
    chosen = metrics.best_parameters(
        pooled, ["outer_fold", "setting"], "loss", [F.col("rank"), F.col("dimension"), tie], ["dimension", "rank", "alpha"]
    )
    return trace, chosen


def chosen_predictions(fitted: Fitted, settings: list[linear.Setting], chosen: DataFrame) -> DataFrame:
    """Outer-fold predictions at the selected parameters."""
    outer = fitted.rows.select("entity", "x", F.filter("test_of", lambda f: ~f.contains("/")).alias("test_of"))
    grid = linear.fold_predictions(outer, fitted.models(), settings, fitted.folds, fitted.components)
    keys = chosen.select(F.col("outer_fold").alias("model_fold"), "setting", "dimension", "rank", "alpha")
    return grid.join(keys, ["model_fold", "setting", "dimension", "rank", "alpha"])


def mean_predictions(rows: DataFrame, names: list[str], group: str) -> DataFrame:
    """Zero, global-mean and group-mean predictors of every fold's test rows, long form."""
    long = vectors.to_long(rows, ["entity", group, "held_of"], "y")
    sums = [F.sum("value").alias("_s"), F.count("value").alias("_n")]
    # training sums = all rows - held-out rows; totals are copied to the folds after aggregation
    totals = long.groupBy(group, "feature").agg(*sums).withColumn("model_fold", F.explode(F.array(*[F.lit(n) for n in names])))
    held = long.withColumn("model_fold", F.explode("held_of")).groupBy("model_fold", group, "feature").agg(*sums)
    signed = totals.unionByName(held.withColumn("_s", -F.col("_s")).withColumn("_n", -F.col("_n")))
    grouped = signed.groupBy("model_fold", group, "feature").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    whole = grouped.groupBy("model_fold", "feature").agg((F.sum("_s") / F.sum("_n")).alias("global_mean"))
    test = rows.select("entity", group, F.explode("test_of").alias("model_fold"))
    joined = test.join(whole, "model_fold").join(grouped, ["model_fold", group, "feature"], "left")
    enough = F.coalesce(F.col("_n") >= vectors.MIN_GROUP, F.lit(False))
    return joined.select(
        "model_fold", "entity", "feature", F.lit(0.0).alias("zero"), "global_mean",
        F.when(enough, F.try_divide(F.col("_s"), F.col("_n"))).otherwise(F.col("global_mean")).alias("group_mean"),
        (~enough).alias("fallback"),
    )


def baseline_losses(fitted: Fitted, group: str, losses: DataFrame, dimensions: tuple[int, ...]) -> DataFrame:
    """Held-out error of five predictors per outer fold and row, their parameters chosen on inner folds.

    zero, global mean, group mean (with its fallback), the nearest training row (with its name) at the chosen
    dimension, and the direct model at the chosen dimension and penalty. `losses` holds the direct grid's losses.
    """
    outer = [f for f in fitted.folds if "/" not in f]
    own = lambda c: F.filter(c, lambda f: ~f.contains("/")).alias(c)
    rows = fitted.rows.select("entity", group, "y", own("test_of"), own("held_of"))
    means = mean_predictions(rows, outer, group).join(vectors.to_long(rows, ["entity"], "y"), ["entity", "feature"])
    gap = lambda c: F.sqrt(F.avg((F.col(c) - F.col("value")) * (F.col(c) - F.col("value")))).alias(c)
    three = means.groupBy("model_fold", "entity").agg(*[gap(c) for c in ("zero", "global_mean", "group_mean")], F.bool_or("fallback").alias("_f"))
    three = three.select("model_fold", "entity", "_f", F.expr("stack(3, 'zero', zero, 'global_mean', global_mean, 'group_mean', group_mean) as (model, rmse)"))
    three = three.withColumn("fallback", F.when(F.col("model") == "group_mean", F.col("_f"))).drop("_f")
    copied = pinned(neighbor_losses(fitted, dimensions))
    grid = copied.unionByName(losses.where("setting = 'direct'").withColumn("neighbor", F.lit(None).cast(dict(copied.dtypes)["neighbor"])))
    keys = ["model_fold", "setting", "dimension", "rank", "alpha"]
    chosen = select_settings(grid)[1].withColumnRenamed("outer_fold", "model_fold").select(*keys)
    two = grid.join(chosen, keys).select("model_fold", "entity", F.col("setting").alias("model"), "rmse", "dimension", "alpha", "neighbor")
    return three.unionByName(two, allowMissingColumns=True)


def novelty(fitted: Fitted, dimension: int) -> DataFrame:
    """Distance from each held-out row to its nearest training row."""
    return nearest_rows(fitted, (dimension,)).select("model_fold", "entity", "neighbor", F.col("distance").alias("novelty"))


def held_out_scores(fitted: Fitted, predictions: DataFrame) -> DataFrame:
    """Observed and predicted response component scores of held-out rows."""
    observed = linear.scores(fitted.rows, fitted.response, "y", fitted.folds, whiten=False, out="observed").where("role = 'test'")
    guess = predictions.select(
        "entity", F.col("predicted").alias("y"), F.array("model_fold").alias("test_of"), F.array("model_fold").alias("held_of")
    )
    predicted = linear.scores(guess, fitted.response, "y", fitted.folds, whiten=False, out="predicted").where("role = 'test'")
    both = observed.join(predicted.select("model_fold", "entity", "predicted"), ["model_fold", "entity"])
    return both.select(
        "model_fold", "entity", F.posexplode(F.arrays_zip("observed", "predicted")).alias("component", "_p")
    ).select("model_fold", "entity", (F.col("component") + 1).alias("component"), "_p.observed", "_p.predicted")


def external_transfer(
    training: DataFrame, external: DataFrame, setting: linear.Setting, components: int, ranks: int = 0,
    max_features: int | dict[str, int] | None = None, min_mean: float | None = None,
) -> DataFrame:
    """Fit once on all training rows, predict rows of entities absent from training."""
    name = ["all"]
    empty = F.array().cast("array<string>")
    rows = training.withColumn("test_of", empty).withColumn("held_of", empty)
    fitted = fit(rows, name, components, ranks, max_features, min_mean)
    unseen = external.join(training.select("entity"), "entity", "left_anti")
    target = unseen.withColumn("test_of", F.array(F.lit("all")))
    return linear.fold_predictions(target, fitted.models(), [setting], name, components)
