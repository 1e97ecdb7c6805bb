"""Exact nearest training row, computed block against block.

No pair is ever emitted: a task gets one bounded block of queries and one
bounded block of training rows and returns one candidate per query.

Of few dimensions the blocks are strips of the training rows in order. A query
meets its own strip and then only those whose box is no farther than the row
found there, so rows are not copied to all blocks. Of more dimensions boxes
rule out nothing, and every block meets every block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.operators import ranking
from dosewise.operators.linear import stack
from dosewise.session import BLOCK_ROWS_KEY, DEFAULT_BLOCK_ROWS, fresh, limit, pinned

# Query rows of a block that are compared at once.
QUERIES_AT_ONCE = 256
# Up to so many dimensions a matrix product saves nothing; rows are swept in order of the first one.
FEW_DIMENSIONS, SWEPT_AT_ONCE = 4, 64
# Values from which squares may not be finite; with such ones nothing is ruled out.
LARGE = 1e150


def blocked(rows: DataFrame, keys: list[str], entity: str, out: str) -> DataFrame:
    """Hash rows of each key into blocks of about blockRows rows; adds the block count."""
    size = limit(rows.sparkSession, BLOCK_ROWS_KEY, DEFAULT_BLOCK_ROWS)
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias(f"{out}s"))
    return rows.join(counts, keys).withColumn(out, F.pmod(F.xxhash64(entity), F.col(f"{out}s")))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, or of all rows to all, summed dimension by dimension."""
    gaps = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for c in range(a.shape[-1]):
        gaps += (a[..., c] - b[..., c]) ** 2
    return gaps


def _plain(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gaps = _squared(a[:, None], b[None])
    at = gaps.argmin(axis=1)
    return at, gaps[np.arange(len(a)), at]


def _swept(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain minimum for queries in order of their first dimension, among rows that are no farther in it than a row found."""
    order, queries = np.argsort(b[:, 0], kind="stable"), np.argsort(a[:, 0], kind="stable")
    line = b[order, 0]
    at, squared = np.zeros(len(a), np.int64), np.zeros(len(a))
    for first in range(0, len(a), SWEPT_AT_ONCE):
        own = queries[first : first + SWEPT_AT_ONCE]
        part, lead = a[own], a[own, 0]
        middle = np.searchsorted(line, lead)
        near = order[max(0, middle[0] - SWEPT_AT_ONCE) : middle[-1] + SWEPT_AT_ONCE]
        reach = np.sqrt(_plain(part, b[near])[1])
        reach += 8 * np.finfo(np.float64).eps * (np.abs(lead) + reach) + np.finfo(np.float64).tiny
        low, high = np.searchsorted(line, (lead - reach).min()), np.searchsorted(line, (lead + reach).max(), side="right")
        left = np.sort(order[low:high])
        found, squared[own] = _plain(part, b[left])
        at[own] = left[found]
    return at, squared


def closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of b nearest to each row of a, the first of equals, and its squared distance.

    One matrix product (or, of few dimensions, the first one) rules out rows of b; the distances to those left are
    summed as if all were, so that the result is the same.
    """
    norms_a, norms_b = np.square(a).sum(axis=1), np.square(b).sum(axis=1)
    slack = 32 * (a.shape[1] + 4) * np.finfo(np.float64).eps * (norms_a + norms_b.max())
    if not np.isfinite(slack).all():
        return _plain(a, b)
    if a.shape[1] <= FEW_DIMENSIONS:
        return _swept(a, b)
    at, squared = np.zeros(len(a), np.int64), np.zeros(len(a))
    for first in range(0, len(a), QUERIES_AT_ONCE):
        part = a[first : first + QUERIES_AT_ONCE]
        own = slice(first, first + len(part))
        rough = norms_b - 2 * (part @ b.T)
        i, j = np.nonzero(rough <= rough.min(axis=1, keepdims=True) + slack[own, None])
        gaps = _squared(part[i], b[j])
        least = np.minimum.reduceat(gaps, np.flatnonzero(np.diff(i, prepend=-1)))
        equal = np.flatnonzero(gaps == least[i])
        equal = equal[np.diff(i[equal], prepend=-1) > 0]
        at[own], squared[own] = j[equal], least
    return at, squared


def _everywhere(
    queries: DataFrame, train: DataFrame, keys: list[str], vector: str, dimensions: list[int] | None, entity: str
) -> DataFrame:
    """(keys, entity, dimension, neighbor, squared) for every query and block of training rows."""
    types = dict(queries.dtypes)
    q = blocked(queries.select(*keys, entity, vector), keys, entity, "_qb")
    t = blocked(train.select(*keys, F.col(entity).alias("neighbor"), F.col(vector).alias("_tv")), keys, "neighbor", "_tb")
    q_blocks = q.select(*keys, "_qbs").distinct()
    t_blocks = t.select(*keys, "_tbs").distinct()
    # each block is copied once per partner block
    group = [*keys, "_qb", "_tb"]
    left = q.join(t_blocks, keys).withColumn("_tb", F.explode(F.expr("sequence(0L, _tbs - 1)"))).select(*group, entity, vector)
    right = t.join(q_blocks, keys).withColumn("_qb", F.explode(F.expr("sequence(0L, _qbs - 1)"))).select(*group, "neighbor", "_tv")
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += f", {entity} {types[entity]}, dimension int, neighbor {types[entity]}, squared double"

    def best(key: tuple, lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if not len(lhs) or not len(rhs):
            return pd.DataFrame()
        rhs = rhs.sort_values("neighbor")
        a, b = stack(lhs[vector]), stack(rhs["_tv"])
        names, out = rhs["neighbor"].to_numpy(), []
        for d in dimensions or [a.shape[1]]:
            if d > a.shape[1]:
                continue
            at, squared = closest(a[:, :d], b[:, :d])
            part = {k: v for k, v in zip(keys, key, strict=False)}
            out.append(pd.DataFrame({
                **part, entity: lhs[entity].to_numpy(), "dimension": d,
                "neighbor": names[at], "squared": squared,
            }))
        return pd.concat(out) if out else pd.DataFrame()

    return left.groupBy(*group).cogroup(fresh(right).groupBy(*group)).applyInPandas(best, schema)


def _in_strips(queries: DataFrame, train: DataFrame, keys: list[str], vector: str, dimensions: list[int], entity: str) -> DataFrame:
    """The same for few dimensions and the strips that may hold the nearest row.

    Strips follow the order of all coordinates, so equal leading ones don't fill a strip; equal training points count
    once, by their lowest entity. A box's squared distance is summed like one of rows, so it never exceeds theirs.
    """
    spark, types = queries.sparkSession, dict(queries.dtypes)
    size = limit(spark, BLOCK_ROWS_KEY, DEFAULT_BLOCK_ROWS)
    cell = [*keys, "dimension"]

    def points(rows: DataFrame) -> DataFrame:
        spread = rows.select(*keys, entity, vector, F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
        return spread.where(F.size(vector) >= F.col("dimension")).withColumn("_v", F.slice(vector, F.lit(1), F.col("dimension"))).drop(vector)

    t = points(train).groupBy(*cell, "_v").agg(F.min(entity).alias(entity)).withColumn("_one", F.lit(1).cast("bigint"))
    q = points(queries).withColumn("_one", F.lit(0).cast("bigint"))
    largest = ranking.largest_group(queries.select(*keys).unionAll(train.select(*keys)), keys)
    placed = ranking.running(t.unionByName(q), cell, [F.asc("_v")], sums={"_upto": "_one"}, largest=largest)
    strip = F.floor(F.greatest(F.col("_upto") - 1, F.lit(0)) / size).cast("bigint")
    placed = pinned(placed.select(*cell, strip.alias("_strip"), entity, "_v", (F.col("_one") == 1).alias("_train")))
    known = placed.where("_train").select(*cell, "_strip", F.col(entity).alias("neighbor"), F.col("_v").alias("_tv"))
    # one row per strip
    ends = [f(F.get("_tv", F.lit(c))).alias(f"_{n}{c}") for c in range(max(dimensions)) for n, f in (("low", F.min), ("high", F.max))]
    boxes = pinned(known.groupBy(*cell, "_strip").agg(*ends))
    away = F.lit(0.0)
    for c in range(max(dimensions)):
        at = F.get("_v", F.lit(c))
        # greatest skips the nulls of dimensions that the box doesn't have
        gap = F.greatest(F.col(f"_low{c}") - at, at - F.col(f"_high{c}"), F.lit(0.0))
        away = away + gap * gap

    group = [*cell, "_strip", "_part"]
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += f", {entity} {types[entity]}, dimension int, _strip bigint, _v array<double>, neighbor {types[entity]}, squared double"

    def best(key: tuple, lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if not len(lhs) or not len(rhs):
            return pd.DataFrame()
        rhs = rhs.sort_values("neighbor")
        at, squared = closest(stack(lhs["_v"]), stack(rhs["_tv"]))
        part = {k: v for k, v in zip(group, key, strict=True) if k != "_part"}
        return pd.DataFrame({
            **part, entity: lhs[entity].to_numpy(), "_v": lhs["_v"].to_numpy(),
            "neighbor": rhs["neighbor"].to_numpy()[at], "squared": squared,
        })

    def met(asked: DataFrame) -> DataFrame:
        """Candidates of (query, strip) rows; a strip is copied for every `size` of its queries."""
        parts = pinned(asked.groupBy(*cell, "_strip").agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_parts")))
        own = F.pmod(F.xxhash64(entity), F.col("_parts"))
        left = asked.join(F.broadcast(parts), [*cell, "_strip"]).select(*cell, "_strip", own.alias("_part"), entity, "_v")
        every = F.explode(F.expr("sequence(0L, _parts - 1)"))
        right = known.join(F.broadcast(parts), [*cell, "_strip"]).select(*cell, "_strip", every.alias("_part"), "neighbor", "_tv")
        return left.groupBy(*group).cogroup(fresh(right).groupBy(*group)).applyInPandas(best, schema)

    first = pinned(met(placed.where("not _train").select(*cell, "_strip", entity, "_v")))
    near = first.withColumnRenamed("_strip", "_first").join(F.broadcast(boxes), cell).where((F.col("_strip") != F.col("_first")) & (away <= F.col("squared")))
    second = met(pinned(near.select(*cell, "_strip", entity, "_v")))
    return first.unionByName(second).drop("_strip", "_v")


def nearest(
    queries: DataFrame, train: DataFrame, keys: list[str], vector: str, dimensions: list[int] | None = None,
    entity: str = "entity",
) -> DataFrame:
    """Nearest training entity per query and leading dimension count, ties to the lower entity.

    Output: keys, entity, dimension, neighbor, distance. Queries whose key has
    no training row are absent.
    """
    few = [d for d in dimensions or [] if d <= FEW_DIMENSIONS]
    if few:
        large = F.exists(vector, lambda v: ~F.coalesce(F.abs(v) < LARGE, F.lit(False)))
        few = few if queries.select(vector).unionAll(train.select(vector)).where(large).isEmpty() else []
    wide = [d for d in dimensions or [] if d not in few]
    found = [_in_strips(queries, train, keys, vector, few, entity)] if few else []
    if wide or not few:
        found.append(_everywhere(queries, train, keys, vector, wide or None, entity))
    winner: Column = F.min_by(F.struct("neighbor", "squared"), F.struct("squared", "neighbor"))
    return reduce(DataFrame.unionByName, found).groupBy(*keys, entity, "dimension").agg(winner.alias("_w")).select(
        *keys, entity, "dimension", F.col("_w.neighbor").alias("neighbor"), F.sqrt("_w.squared").alias("distance")
    )
