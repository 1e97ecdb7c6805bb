"""Bootstrap of entities, shared by all features: a replicate draws entities once and every feature uses its counts.

The counts are matrices of one byte a count, for a few replicates and a block of
entities each. Features are hashed into chunks; a task multiplies one block of
values with its matrices one after the other, so its memory does not grow with
the data and no draw is made twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.functions.draws import draw_below
from dosewise.functions.hashes import order_numbers
from dosewise.operators import ranking
from dosewise.operators.linear import sum_blocks
from dosewise.operators.resample import BOOTSTRAPS, HIGH, LOW
from dosewise.session import fresh, pinned

# Features (about, they are hashed) and entities that meet in one task.
CHUNK = 256
BLOCK = 4096
# Replicates of one matrix of counts.
REPLICATES = 50


def draw_counts(spark, entities: int, count: int, seed: int | str) -> DataFrame:
    """(pos, draws ARRAY<STRUCT<rep, times>>): how often each of `count` replicates of n draws takes position pos."""
    drawn = spark.range(entities * count).select(
        F.floor(F.col("id") / entities).alias("rep"), (F.col("id") % entities + 1).alias("at")
    ).select("rep", (draw_below(F.lit(entities).cast("bigint"), seed, "rep", "at") + 1).alias("pos"))
    times = drawn.groupBy("pos", "rep").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("pos").agg(
        F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), F.col("times").cast("int").alias("times"))).alias("draws")
    )


def count_matrices(spark, entities: int, count: int, seed: int | str, size: int) -> DataFrame:
    """(block, first, times BINARY): the same counts for replicates from `first` and the positions of one block.

    A block is `size` positions; the matrix has a row for each replicate. A count takes one byte if all of the matrix do,
    else four.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first in [int(f) for batch in batches for f in batch["first"]]:
            drawn = [order_numbers([f"{seed}|{rep}"], entities)[0] % entities for rep in range(first, min(count, first + REPLICATES))]
            times = np.array([np.bincount(d, minlength=entities) for d in drawn])
            times = times.astype(np.uint8 if times.max() < 256 else np.uint32)
            for block, at in enumerate(range(0, entities, size)):
                yield pd.DataFrame({"block": [block], "first": [first], "times": [times[:, at : at + size].tobytes()]})

    starts = spark.range(0, count, REPLICATES, math.ceil(count / REPLICATES)).select(F.col("id").alias("first"))
    return starts.mapInPandas(run, "block long, first long, times binary")


def feature_intervals(
    values: DataFrame, feature: str, entity: str, value: str, seed: int | str, count: int = BOOTSTRAPS
) -> DataFrame:
    """Percentile interval of each feature's mean over bootstrap samples of the entities.

    Output: feature, ci_low, ci_high. Entities are all those with a finite value
    of any feature, in their order; a replicate's mean is over the drawn
    entities that have the feature, and a replicate that draws none of them is
    left out. Null and non-finite values are left out, null features and
    entities too; an (entity, feature) given twice counts twice. An empty table
    gives no rows.
    """
    spark = values.sparkSession
    kept = values.where(S.is_finite(value) & F.col(feature).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(feature).alias("feature"), F.col(entity).alias("entity"), F.col(value).cast("double").alias("value")
    )
    kept = pinned(kept)
    kind = dict(kept.dtypes)["feature"]
    listed = kept.select("entity").distinct()
    sizes = kept.agg(F.count_distinct("entity").alias("e"), F.count_distinct("feature").alias("f")).first()
    n, chunks = sizes["e"], max(1, math.ceil(sizes["f"] / CHUNK))
    placed = pinned(ranking.row_index(listed, [], [F.asc("entity")], "pos", largest=n))
    chunk = F.pmod(F.xxhash64("feature"), F.lit(chunks)).alias("chunk")
    left = kept.join(placed, "entity").select(
        chunk, F.floor((F.col("pos") - 1) / BLOCK).alias("block"), "feature", ((F.col("pos") - 1) % BLOCK).cast("int").alias("spot"), "value"
    )
    counts = count_matrices(spark, max(n, 1), count, seed, BLOCK).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk"), "block", "first", "times"
    )
    size = BLOCK

    def product(key: tuple, rows: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(draws):
            return pd.DataFrame()
        f, names = pd.factorize(rows["feature"], use_na_sentinel=False)
        width = min(size, n - size * key[1])
        cell, shape = f * width + rows["spot"].to_numpy(), (len(names), width)
        sums = np.bincount(cell, rows["value"].to_numpy(), len(names) * width).reshape(shape)
        given = np.bincount(cell, minlength=len(names) * width).reshape(shape).astype(np.float64)
        stat = np.zeros((len(names), 2 * count))
        for first, times in zip(draws["first"], draws["times"], strict=True):
            reps = min(count, first + REPLICATES) - first
            weights = np.frombuffer(times, np.uint8 if len(times) == reps * width else np.uint32).reshape(reps, width).T.astype(np.float64)
            stat[:, first : first + reps], stat[:, count + first : count + first + reps] = sums @ weights, given @ weights
        return pd.DataFrame({"feature": names, "stat": list(stat)})

    schema = f"feature {kind}, stat array<double>"
    keys = ["chunk", "block"]
    parts = left.groupBy(*keys).cogroup(fresh(counts).groupBy(*keys)).applyInPandas(product, schema)

    def bounds(batches):
        for pdf in batches:
            out = []
            for name, stat in zip(pdf["feature"], pdf["stat"], strict=True):
                total, weight = np.asarray(stat[:count]), np.asarray(stat[count:])
                out.append([name, *np.quantile(total[weight > 0] / weight[weight > 0], [LOW, HIGH])])
            if out:
                yield pd.DataFrame(out, columns=["feature", "ci_low", "ci_high"])

    return sum_blocks(parts, ["feature"]).mapInPandas(bounds, f"feature {kind}, ci_low double, ci_high double").withColumnRenamed(
        "feature", feature
    )
