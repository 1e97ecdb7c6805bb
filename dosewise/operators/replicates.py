"""Bootstrap and permutation statistics of many tests, a block of replicates at a time.

A test's values are packed into rows of PACK positions as arrays. A task takes a block of tests and a block of
replicates; the md5 draws depend on (seed, replicate, position) only, so they are made once for all tests of the block
and nothing that grows with replicates times positions is kept, written or shuffled.
Ranks are never sorted again: of a bootstrap sample the draws of each level of the values are counted, and the level's
average rank follows from the counts. A permutation is one gather from the values.

The draws are those of `resample.bootstrap_rows` and `resample.permuted`; results differ by rounding only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.hashes import order_numbers
from dosewise.operators import ranking
from dosewise.session import pinned

# Values of the tests that one task holds, and of one matrix of replicates by positions.
HELD_VALUES = 4_000_000
MATRIX_VALUES = 1_000_000
# Positions of a test in one packed row, and rows that one task packs.
PACK = 16_384
PACKED_AT_ONCE = 500_000


def draws(seed: str, first: int, last: int, n: int) -> np.ndarray:
    """60-bit numbers of replicates first..last-1 (rows) and positions 1..n; `draws.order_number` as a matrix."""
    return order_numbers([f"{seed}|{rep}" for rep in range(first, last)], n)


def random_order(numbers: np.ndarray) -> np.ndarray:
    """Places (from 0) of each row in the order of (number, place), for numbers of 60 bits.

    The leading bits are sorted together with the place, which is faster than sorting places by number; rows in which
    that does not give the order are sorted again.
    """
    n = numbers.shape[1]
    bits = max(1, int(n - 1).bit_length())
    drop = max(0, bits - 3)
    found = np.sort((numbers >> drop) << bits | np.arange(n), axis=1) & ((1 << bits) - 1)
    placed = np.take_along_axis(numbers, found, axis=1)
    for k, at in zip(*np.nonzero(placed[:, 1:] < placed[:, :-1]), strict=True):
        found[k, [at, at + 1]] = found[k, [at + 1, at]]
        placed[k, [at, at + 1]] = placed[k, [at + 1, at]]
    for k in np.flatnonzero((placed[:, 1:] < placed[:, :-1]).any(axis=1)):
        found[k] = np.argsort(numbers[k], kind="stable")
    return found


class Draws:
    """Numbers of one block of replicates, and what follows from them for tests of n values."""

    def __init__(self, seed: str, first: int, last: int, longest: int) -> None:
        self.numbers = draws(seed, first, last, longest)
        self._orders: dict[int, np.ndarray] = {}

    def order(self, n: int) -> np.ndarray:
        """Positions (from 0) in random order, a row for each replicate."""
        if n not in self._orders:
            self._orders = {n: random_order(self.numbers[:, :n])}
        return self._orders[n]

    def sample(self, n: int) -> np.ndarray:
        """n positions (from 0) drawn with replacement."""
        return self.numbers[:, :n] % n


def _counts(levels: np.ndarray, size: int) -> np.ndarray:
    """How often each level is drawn, a row for each replicate."""
    rows = len(levels)
    return np.bincount((levels + np.arange(rows)[:, None] * size).ravel(), minlength=rows * size).reshape(rows, size)


def _level_ranks(counts: np.ndarray) -> np.ndarray:
    """Average rank of each level in its replicate."""
    return np.cumsum(counts, axis=1) - counts + (counts + 1) / 2.0


def drawn_ranks(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Average ranks of the drawn values inside each replicate."""
    names, level = np.unique(values, return_inverse=True)
    return np.take_along_axis(_level_ranks(_counts(level[at], len(names))), level[at], axis=1)


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row; NaN where a side is constant."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), scale, out=np.full(len(a), np.nan), where=scale > 0)


def spearman(test: dict, block: Draws) -> np.ndarray:
    """Correlation of the re-ranked x and y of each bootstrap sample."""
    at = block.sample(len(test["x"]))
    return correlations(drawn_ranks(test["x"], at), drawn_ranks(test["y"], at))


def partial_spearman(test: dict, block: Draws) -> np.ndarray:
    """The same, given the re-ranked z."""
    at = block.sample(len(test["x"]))
    a, b, c = (drawn_ranks(test[k], at) for k in "xyz")
    xy, xz, yz = correlations(a, b), correlations(a, c), correlations(b, c)
    scale = np.sqrt(np.maximum((1 - xz * xz) * (1 - yz * yz), 0.0))
    return np.divide(xy - xz * yz, scale, out=np.full(len(xy), np.nan), where=scale > 0)


def permuted_product(test: dict, block: Draws) -> np.ndarray:
    """Sum of products of the permuted a with b."""
    return test["a"][block.order(len(test["a"]))] @ test["b"]


def permuted_head(test: dict, block: Draws) -> np.ndarray:
    """Sum of as many permuted values as are flagged."""
    v, flagged = test["v"], int(test["f"].sum())
    if not flagged:
        return np.zeros(len(block.numbers))
    sums = []
    for numbers in block.numbers[:, : len(v)]:
        first = numbers <= np.partition(numbers, flagged - 1)[flagged - 1]
        # equal numbers go by position
        sums.append(v[first].sum() if first.sum() == flagged else v[random_order(numbers[None])[0, :flagged]].sum())
    return np.array(sums)


def drawn_mean(test: dict, block: Draws) -> np.ndarray:
    """Mean of each bootstrap sample."""
    return test["v"][block.sample(len(test["v"]))].mean(axis=1)


def stratified_delta(test: dict, block: Draws) -> np.ndarray:
    """Cliff's delta of samples drawn from the flagged and from the other values."""
    names, level = np.unique(test["v"], return_inverse=True)
    flag = test["f"].astype(bool)
    # positions inside a stratum follow its own order
    inside = [np.flatnonzero(side)[np.argsort(test["stratum_pos"][side], kind="stable")] for side in (flag, ~flag)]
    n1, n0 = map(len, inside)
    if not n1 or not n0:
        return np.full(len(block.numbers), np.nan)
    one, none = (_counts(level[own[block.sample(len(own))]], len(names)) for own in inside)
    rank_sum = (_level_ranks(one + none) * one).sum(axis=1)
    return 2.0 * (rank_sum - n1 * (n1 + 1) / 2.0) / (n1 * n0) - 1.0


def permuted_between(test: dict, block: Draws) -> np.ndarray:
    """Sum of squares between groups after the permuted centred values have met the labels."""
    labels, code, sizes = np.unique(test["g"], return_inverse=True, return_counts=True)
    order = block.order(len(code))
    sums = np.array([np.bincount(code, test["d"].take(places), len(labels)) for places in order])
    return (sums * sums / sizes).sum(axis=1)


def statistics(
    base: DataFrame, keys: list[str], values: list[str], statistic: Callable[[dict, Draws], np.ndarray], count: int, seed: int | str, out: str, rows: int,
) -> DataFrame:
    """(keys, rep, out): the statistic of every test and replicate 0..count-1, null where it is undefined.

    `base` is a checkpointed table of `rows` rows with `pos` 1..n per key. A test's values are held by one task, 8 bytes
    each, so give groups of a checked size.
    """
    cores = base.sparkSession.sparkContext.defaultParallelism
    blocks = math.ceil(max(1, rows) / HELD_VALUES)
    tests = pinned(base.select(*keys).distinct().withColumn("_test", F.monotonically_increasing_id()))
    numbered = ranking.join_null_safe(base, tests, keys).select("_test", F.floor(F.col("pos") / PACK).alias("_pack"), "pos", *values)
    numbered = numbered.repartition(max(cores, math.ceil(rows / PACKED_AT_ONCE)), "_test", "_pack")
    ordered = F.array_sort(F.collect_list(F.struct("pos", *values)))
    packs = numbered.groupBy("_test", "_pack").agg(ordered.alias("_rows")).select(
        "_test", "_pack", *[F.col("_rows").getField(c).alias(f"_{c}") for c in values])
    step = max(1, math.ceil(count * blocks / cores / 2))
    dealt = pinned(packs).withColumn("_block", F.pmod(F.xxhash64("_test"), F.lit(blocks))).withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(count - 1), F.lit(step))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, held = int(group["_from"].iloc[0]), {}
        for id_, own in group.sort_values(["_test", "_pack"]).groupby("_test"):
            held[id_] = {c: np.concatenate(own[f"_{c}"].tolist()).astype(np.float64 if c != "g" else np.int64) for c in values}
        size = lambda id_: len(held[id_][values[0]])
        longest = max(map(size, held))
        parts, at_once = [], max(1, MATRIX_VALUES // longest)
        for low in range(first, min(count, first + step), at_once):
            high = min(count, first + step, low + at_once)
            block = Draws(str(seed), low, high, longest)
            for id_ in sorted(held, key=size):
                parts.append(pd.DataFrame({"_test": id_, "rep": np.arange(low, high), "_s": statistic(held[id_], block)}))
        return pd.concat(parts)

    found = dealt.groupBy("_block", "_from").applyInPandas(run, "_test long, rep int, _s double")
    named = found.join(tests, "_test")
    return named.select(*keys, "rep", F.when(~F.isnan("_s"), F.col("_s")).alias(out))


def codes(df: DataFrame, keys: list[str], label: str, out: str) -> DataFrame:
    """Adds a number for each distinct label of a key."""
    found = df.select(*keys, label).distinct().withColumn(out, F.monotonically_increasing_id())
    return ranking.join_null_safe(df, pinned(found), [*keys, label])
