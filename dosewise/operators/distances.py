"""Distribution distances between two samples of vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.draws import draw_below
from dosewise.operators import ranking
from dosewise.operators.linear import apply_models, fit_pca, load_projection, stack
from dosewise.session import BLOCK_ROWS_KEY, DEFAULT_BLOCK_ROWS, fresh, limit, pinned

SIDES = ("x", "y")
# Rows of a block that meet the other block at once.
ROWS_AT_ONCE = 256
# Squared distances below this share of the squared norms are summed dimension by dimension; up to so many of all pairs.
NEAR, NEAR_PAIRS = 1e-4, 0.05


def distance_sum(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the distances of all rows of a to all rows of b.

    Squared distances come from one matrix product, and those that it would blur from the differences.
    """
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    norms_a, norms_b = np.square(a).sum(axis=1), np.square(b).sum(axis=1)
    product = bool(np.isfinite(norms_a).all() and np.isfinite(norms_b).all())
    total = 0.0
    for first in range(0, len(a), ROWS_AT_ONCE):
        part = a[first : first + ROWS_AT_ONCE]
        scale = norms_a[first : first + ROWS_AT_ONCE, None] + norms_b[None]
        near = None
        if product:
            squares = scale - 2 * (part @ b.T)
            near = squares <= NEAR * scale
        if near is None or np.count_nonzero(near) > NEAR_PAIRS * near.size:
            squares = np.zeros((len(part), len(b)))
            for c in range(a.shape[1]):
                squares += (part[:, c, None] - b[None, :, c]) ** 2
        else:
            i, j = np.nonzero(near)
            squares[i, j] = np.square(part[i] - b[j]).sum(axis=1)
        total += float(np.sqrt(squares).sum())
    return total


def energy_distance(rows: DataFrame, keys: list[str], side: str, entity: str, vector: str) -> DataFrame:
    """2 E|x-y| - E|x-x'| - E|y-y'| per key, self pairs included, floored at 0.

    The pairwise sums run block against block; each task holds two bounded
    blocks and returns one number.
    """
    size = limit(rows.sparkSession, BLOCK_ROWS_KEY, DEFAULT_BLOCK_ROWS)
    types = dict(rows.dtypes)
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col(side) == s).alias(f"n_{s}") for s in SIDES])
    counts = counts.where("n_x > 0 and n_y > 0")
    sized = rows.select(*keys, F.col(side).alias("side"), entity, vector).join(
        counts.select(*keys, *[F.ceil(F.col(f"n_{s}") / size).cast("bigint").alias(f"b_{s}") for s in SIDES]), keys
    )
    own = F.when(F.col("side") == "x", F.col("b_x")).otherwise(F.col("b_y"))
    placed = sized.withColumn("block", F.pmod(F.xxhash64(entity), own))
    partners = lambda s, start: F.transform(
        F.when(start < F.col(f"b_{s}"), F.sequence(start, F.col(f"b_{s}") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda j: F.struct(F.lit(s).alias("s"), j.alias("j")),
    )
    upto = lambda s, end: F.transform(
        F.sequence(F.lit(0).cast("bigint"), end), lambda j: F.struct(F.lit(s).alias("s"), j.alias("j"))
    )
    zero = F.lit(0).cast("bigint")
    # unordered block pairs: (x,i)-(x,j>=i), (x,i)-(y,all), (y,i)-(y,j>=i)
    as_left = F.when(F.col("side") == "x", F.concat(partners("x", F.col("block")), partners("y", zero))).otherwise(
        partners("y", F.col("block"))
    )
    as_right = F.when(F.col("side") == "x", upto("x", F.col("block"))).otherwise(
        F.concat(upto("x", F.col("b_x") - 1), upto("y", F.col("block")))
    )
    lhs = placed.withColumn("_p", F.explode(as_left)).select(
        *keys, F.col("side").alias("ls"), F.col("block").alias("lb"), F.col("_p.s").alias("rs"), F.col("_p.j").alias("rb"), vector
    )
    rhs = placed.withColumn("_p", F.explode(as_right)).select(
        *keys, F.col("_p.s").alias("ls"), F.col("_p.j").alias("lb"), F.col("side").alias("rs"), F.col("block").alias("rb"), vector
    )
    pair = [*keys, "ls", "lb", "rs", "rb"]
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ls string, rs string, total double"

    def block_sum(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = distance_sum(stack(left[vector]), stack(right[vector])) if len(left) and len(right) else 0.0
        ls, lb, rs, rb = key[len(keys):]
        weight = 2.0 if ls == rs and lb != rb else 1.0
        return pd.DataFrame([[*key[: len(keys)], ls, rs, weight * total]], columns=[*keys, "ls", "rs", "total"])

    sums = lhs.groupBy(*pair).cogroup(fresh(rhs).groupBy(*pair)).applyInPandas(block_sum, schema)
    part = lambda a, b: F.sum(F.when((F.col("ls") == a) & (F.col("rs") == b), F.col("total")).otherwise(0.0))
    wide = sums.groupBy(*keys).agg(part("x", "x").alias("_xx"), part("x", "y").alias("_xy"), part("y", "y").alias("_yy"))
    nx, ny = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    value = 2 * F.col("_xy") / (nx * ny) - F.col("_xx") / (nx * nx) - F.col("_yy") / (ny * ny)
    return wide.join(counts, keys).select(*keys, "n_x", "n_y", F.greatest(value, F.lit(0.0)).alias("energy_distance"))


def directions(spark, count: int, dimensions: int, seed: int | str) -> DataFrame:
    """Unit directions from md5 normals (Box-Muller): one row per direction."""
    grid = spark.range(count).withColumnRenamed("id", "direction").withColumn(
        "dim", F.explode(F.sequence(F.lit(1), F.lit(dimensions)))
    )
    scale = F.lit(1 << 32).cast("bigint")
    u = lambda tag: (draw_below(scale, seed, F.lit(tag), "direction", "dim") + 0.5) / float(1 << 32)
    normal = grid.withColumn("w", F.sqrt(-2.0 * F.ln(u("a"))) * F.cos(2 * math.pi * u("b")))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "w"))), lambda e: e["w"])
    vectors = normal.groupBy("direction").agg(packed.alias("w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return vectors.select("direction", F.transform("w", lambda v: v / F.col("_n")).alias("weights"))


def project_directions(rows: DataFrame, dirs: DataFrame, count: int, vector: str, out: str = "v") -> DataFrame:
    """One row per (row, direction) with the projected value; `dirs` has `count` rows."""
    spread = rows.withColumn("direction", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    joined = spread.join(F.broadcast(dirs), "direction")
    products = F.zip_with(F.col(vector).cast("array<double>"), "weights", lambda a, b: a * b)
    placed = joined.withColumn("_dot", F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)).drop("weights", vector)
    return placed.withColumnRenamed("_dot", out)


def wasserstein_1d(rows: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Exact 1-D Wasserstein distance per key from the two empirical CDFs."""
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(
        *[F.count_if(F.col(side) == s).alias(f"_c{s}") for s in SIDES]
    )
    steps = ranking.running(
        counted, keys, [F.asc("_v")], sums={"_ux": "_cx", "_uy": "_cy"}, nexts={"_next": "_v"}
    )
    totals = counted.groupBy(*keys).agg(F.sum("_cx").alias("_nx"), F.sum("_cy").alias("_ny")).where("_nx > 0 and _ny > 0")
    gap = F.abs(F.col("_ux") / F.col("_nx") - F.col("_uy") / F.col("_ny")) * (F.col("_next") - F.col("_v"))
    return steps.join(totals, keys).groupBy(*keys).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("wasserstein"))


def sliced_wasserstein(rows: DataFrame, keys: list[str], side: str, vector: str, dirs: DataFrame, count: int) -> DataFrame:
    """Mean 1-D distance over fixed directions."""
    projected = project_directions(rows.select(*keys, side, vector), dirs, count, vector)
    return wasserstein_1d(projected, [*keys, "direction"], side, "v").groupBy(*keys).agg(
        F.avg("wasserstein").alias("sliced_wasserstein")
    )


def shifted_cells(cells: DataFrame, shifts: DataFrame, entity: str, vector: str, shift: str = "shift") -> DataFrame:
    """Control cells moved by each model's latent shift of their entity."""
    moved = F.zip_with(F.col(vector).cast("array<double>"), F.col(shift), lambda a, b: a + b)
    return cells.join(shifts, entity).withColumn(vector, moved).drop(shift)


def latent_shift(deltas: DataFrame, loadings: DataFrame, keys: list[str], feature: str = "feature", value: str = "delta") -> DataFrame:
    """Project predicted deltas on components without centring; one array per key."""
    sums = deltas.join(loadings, feature).groupBy(*keys, "component").agg(
        F.sum(F.col(value) * F.col("loading")).alias("_s")
    )
    packed = F.transform(F.array_sort(F.collect_list(F.struct("component", "_s"))), lambda e: e["_s"])
    return sums.groupBy(*keys).agg(packed.alias("shift"))


def control_components(
    rows: DataFrame, side: str, entity: str, vector: str, components: int, max_features: int | None = None
) -> DataFrame:
    """Components fitted on the control side ("x") only; the other side never enters means, selection or axes."""
    fold = F.lit("control")
    held = F.when(F.col(side) == "x", F.array().cast("array<string>")).otherwise(F.array(fold))
    fit = rows.select(F.col(entity).alias("entity"), F.col(vector).alias("x"), held.alias("test_of"), held.alias("held_of"))
    return pinned(fit_pca(pinned(fit), "x", ["control"], components, max_features))


def in_components(rows: DataFrame, pca: DataFrame, vector: str, entity: str, centre: bool) -> DataFrame:
    """The same rows with `vector` replaced by its scores; shifts are projected without centring."""
    schema = ", ".join(f"`{c}` {'array<double>' if c == vector else t}" for c, t in rows.dtypes)
    columns = rows.columns

    def project(models: dict, pdf: pd.DataFrame):
        model = models["control"]
        data = stack(pdf[vector])
        z = model.scores(data, False) if centre else data @ model.loadings
        yield pdf[columns].assign(**{vector: list(z)})

    return apply_models(rows, pca, "loading", ["control"], load_projection, project, schema, columns, entity)


def promotion_gate(intervals: DataFrame, keys: list[str], low: str = "ci_low") -> DataFrame:
    """Promote only when the lower bound is positive for every metric."""
    return intervals.groupBy(*keys).agg(
        F.bool_and(F.col(low) > 0).alias("promoted"), F.count(F.lit(1)).alias("n_metrics"), F.min(low).alias("worst_low")
    )
