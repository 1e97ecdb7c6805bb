"""Ranks, running totals and quantiles that do not need a whole group in one task.

A plain window sorts each group inside one task. That is right for groups with
a fixed bound (features of a dictionary, replicates of a bootstrap) and wrong
for a group that may hold a third of all rows. Two exact ways are used instead:

* `hash_rank`: the order is a uniform hash, so its leading hex digits split a
  large group evenly; local row numbers plus per-bucket offsets give the rank.
* `running`: the order is a value. Group sizes are checked first; when the
  largest exceeds the window limit the rows are range-partitioned on
  (keys, order), checkpointed so block borders cannot move, and block totals
  are carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import DEFAULT_WINDOW_ROWS, WINDOW_ROWS_KEY, limit, pinned

HASH_DIGITS = 3


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's keys are not repeated."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_k_{k}" for k in keys])


def largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def hash_rank(
    df: DataFrame, keys: list[str], hash_col: Column, ties: list[str],
    out: str = "rn", size: str | None = None, digits: int = HASH_DIGITS, largest: int | None = None,
) -> DataFrame:
    """1-based rank by (hash, ties) within keys; optionally the group size too.

    `largest` is a known bound on the group size; without it the sizes are
    counted. Groups under the window limit take a plain window.
    """
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= limit(df.sparkSession, WINDOW_ROWS_KEY, DEFAULT_WINDOW_ROWS):
        part = Window.partitionBy(*keys)
        ranked = df.withColumn("_h", hash_col).withColumn(
            out, F.row_number().over(part.orderBy("_h", *ties)).cast("bigint")
        )
        if size:
            ranked = ranked.withColumn(size, F.count(F.lit(1)).over(part))
        return ranked.drop("_h")
    tagged = df.withColumn("_h", hash_col).withColumn("_b", F.substring("_h", 1, digits))
    # at most 16**digits rows per group from here on
    counts = tagged.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias("_size"),
    )
    local = Window.partitionBy(*keys, "_b").orderBy("_h", *ties)
    ranked = join_null_safe(tagged.withColumn("_rn", F.row_number().over(local)), offsets, [*keys, "_b"])
    ranked = ranked.withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
    if size:
        ranked = ranked.withColumn(size, F.col("_size").cast("bigint"))
    return ranked.drop("_h", "_b", "_off", "_rn", "_size")


def running(
    df: DataFrame, keys: list[str], order: list[Column],
    sums: dict[str, str] | None = None, mins: dict[str, str] | None = None,
    nexts: dict[str, str] | None = None, largest: int | None = None,
) -> DataFrame:
    """Inclusive running sums / minima, and the next row's value, in `order`.

    `nexts` columns must be non-decreasing in the order. `largest` is a known
    bound on the group size; without it the sizes are counted.
    """
    sums, mins, nexts = sums or {}, mins or {}, nexts or {}
    size = largest_group(df, keys) if largest is None else largest
    split = size > limit(df.sparkSession, WINDOW_ROWS_KEY, DEFAULT_WINDOW_ROWS)
    parts = list(keys)
    if split:
        df = pinned(
            df.repartitionByRange(*[F.col(k) for k in keys], *order)
            .withColumn("_block", F.spark_partition_id())
        )
        parts.append("_block")
    ordered = Window.partitionBy(*parts).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = df.select(
        "*",
        *[F.sum(c).over(upto).alias(o) for o, c in sums.items()],
        *[F.min(c).over(upto).alias(o) for o, c in mins.items()],
        *[F.lead(c).over(ordered).alias(o) for o, c in nexts.items()],
    )
    if not split:
        return result
    totals = df.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.min(c).alias(f"_m_{o}") for o, c in mins.items()],
        *[F.min(c).alias(f"_f_{o}") for o, c in nexts.items()],
    )
    # one row per range partition touched by the group
    chain = Window.partitionBy(*keys).orderBy("_block")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *parts,
        *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_s_{o}") for o in sums],
        *[F.min(f"_m_{o}").over(earlier).alias(f"_m_{o}") for o in mins],
        *[F.lead(f"_f_{o}").over(chain).alias(f"_f_{o}") for o in nexts],
    )
    joined = join_null_safe(result, carry, parts)
    for o in sums:
        joined = joined.withColumn(o, F.col(o) + F.col(f"_s_{o}"))
    for o in mins:
        joined = joined.withColumn(o, F.least(o, f"_m_{o}"))
    for o in nexts:
        joined = joined.withColumn(o, F.coalesce(o, f"_f_{o}"))
    return joined.drop(
        "_block", *[f"_s_{o}" for o in sums], *[f"_m_{o}" for o in mins], *[f"_f_{o}" for o in nexts]
    )


def row_index(
    df: DataFrame, keys: list[str], order: list[Column], out: str = "rn", largest: int | None = None
) -> DataFrame:
    """1-based position in a total order (the order must end in a unique column)."""
    return running(
        df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, sums={out: "_one"}, largest=largest
    ).drop("_one")


def average_rank(
    df: DataFrame, keys: list[str], value: str, out: str, largest: int | None = None
) -> DataFrame:
    """Average rank: tied values share the mean of their positions."""
    size = largest_group(df, keys) if largest is None else largest
    if size <= limit(df.sparkSession, WINDOW_ROWS_KEY, DEFAULT_WINDOW_ROWS):
        w = Window.partitionBy(*keys).orderBy(value)
        # RANGE frame ends at the last tie: rank and last position give the mean
        last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(out, (F.rank().over(w) + last) / 2.0)
    distinct = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running(distinct, keys, [F.col(value)], sums={"_upto": "_c"}, largest=size).select(
        *keys, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out)
    )
    return join_null_safe(df, ranks, [*keys, value])


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], largest: int | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles of the non-null values per key."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    size = largest_group(rows, keys) if largest is None else largest
    if size <= limit(df.sparkSession, WINDOW_ROWS_KEY, DEFAULT_WINDOW_ROWS):
        return rows.groupBy(*keys).agg(*[F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()])
    distinct = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = running(distinct, keys, [F.col("_v")], sums={"_upto": "_c"}, largest=size)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = join_null_safe(upto, totals, keys) if keys else upto.withColumn("_n", F.lit(size))
    aggs = []
    for i, p in enumerate(probs.values()):
        at = (F.col("_n") - 1) * F.lit(float(p))
        # the value at 0-based index k is the smallest whose running count exceeds k
        aggs.append(F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
    picked = placed.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name)
            for i, name in enumerate(probs)
        ],
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """First n rows per key.

    The row_number filter is pushed below the shuffle (window group limit), so a
    hot key sends at most n rows per map task.
    """
    rows = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where(F.col(out) <= n)
