"""Feature sets: panels, scores, over-representation, multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.functions.scalar import ordered_join
from dosewise.operators import ranking

def collection_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("collection").agg(F.count_distinct("symbol").cast("bigint").alias("set_size"))


def panel_features(genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every feature whose symbol is in the panel; a panel that maps to nothing is an error."""
    found = genes.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    if found.isEmpty():
        raise ValueError("no symbol of the panel is in the dictionary")
    return found


def set_scores(deltas: DataFrame, features: DataFrame, keys: list[str], feature: str = "feature", value: str = "delta") -> DataFrame:
    """Mean value over the mapped features of each collection; unmapped sets are absent."""
    return deltas.join(features.select("collection", feature).distinct(), feature).groupBy(*keys, "collection").agg(
        F.avg(value).alias("score"), F.count_distinct(feature).alias("mapped")
    )


def overlaps(top: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of every tested list with every collection, zeros included."""
    sizes = collection_sizes(sets)
    grid = (
        top.groupBy(*keys).agg(F.count_distinct("symbol").cast("bigint").alias("top_size"))
        .withColumn("_j", F.lit(1)).join(sizes.withColumn("_j", F.lit(1)), "_j").drop("_j")
    )
    hits = top.join(sets, "symbol").groupBy(*keys, "collection").agg(
        F.count_distinct("symbol").cast("bigint").alias("overlap"), ordered_join(F.col("symbol")).alias("overlap_symbols")
    )
    return grid.join(hits, [*keys, "collection"], "left").fillna({"overlap": 0, "overlap_symbols": ""})


def log_factorial(n: Column) -> Column:
    """ln(n!) from Stirling's series on an argument shifted by 16 (relative error below 1e-13)."""
    x = n.cast("double") + 1.0
    product = x
    for step in range(1, 16):
        product = product * (x + step)
    z = x + 16.0
    series = (
        1.0 / (12.0 * z) - 1.0 / (360.0 * F.pow(z, 3)) + 1.0 / (1260.0 * F.pow(z, 5)) - 1.0 / (1680.0 * F.pow(z, 7))
    )
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(overlap: Column, universe: Column, set_size: Column, top_size: Column) -> Column:
    """P(X >= overlap) when top_size symbols are taken from the universe."""
    # X cannot be below this even for the poorest draw
    low = F.greatest(overlap, set_size + top_size - universe, F.lit(0).cast("bigint"))
    high = F.least(set_size, top_size)
    base = log_choose(universe, top_size)

    def mass(acc: Column, i: Column) -> Column:
        return acc + F.exp(log_choose(set_size, i) + log_choose(universe - set_size, top_size - i) - base)

    tail = F.aggregate(F.sequence(low, high), F.lit(0.0), mass)
    return F.when(overlap <= 0, 1.0).when(low > high, 0.0).otherwise(F.least(tail, F.lit(1.0)))


def benjamini_hochberg(
    tests: DataFrame, family: list[str], p: str, ids: list[str], out: str = "fdr_bh", largest: int | None = None
) -> DataFrame:
    """Adjusted p-values per family; rows with NULL p keep NULL and do not count.

    A p outside [0, 1] is an error; a NULL family is a family.
    """
    if not tests.where(~F.col(p).between(0, 1)).isEmpty():
        raise ValueError("p-values must lie between 0 and 1")
    valid, skipped = tests.where(F.col(p).isNotNull()), tests.where(F.col(p).isNull())
    if largest is None:
        largest = ranking.largest_group(valid, family)
    ranked = ranking.row_index(valid, family, [F.asc(p), *[F.asc(i) for i in ids]], "_rank", largest)
    # a constant key keeps one family from becoming a cross join
    sizes = valid.groupBy(*family, F.lit(1).alias("_j")).agg(F.count(F.lit(1)).alias("_m"))
    raw = ranking.join_null_safe(ranked.withColumn("_j", F.lit(1)), sizes, [*family, "_j"]).withColumn(
        "_raw", F.col(p) * F.col("_m") / F.col("_rank")
    )
    adjusted = ranking.running(raw, family, [F.desc("_rank")], mins={"_q": "_raw"}, largest=largest)
    done = adjusted.withColumn(out, F.greatest(F.least("_q", F.lit(1.0)), F.lit(0.0))).drop("_rank", "_j", "_m", "_raw", "_q")
    return done.unionByName(skipped.withColumn(out, F.lit(None).cast("double")))


def over_representation(top: DataFrame, sets: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """Tail probability per (list, collection) and one adjusted family over all tests."""
    total = universe.select("symbol").distinct().count()
    tested = overlaps(top, sets, keys).withColumn(
        "p_value",
        hypergeometric_tail(F.col("overlap"), F.lit(total).cast("bigint"), F.col("set_size"), F.col("top_size")),
    )
    return benjamini_hochberg(tested, [], "p_value", [*keys, "collection"])


def panel_coverage(sets: DataFrame, genes: DataFrame, selected: DataFrame, feature: str = "feature") -> DataFrame:
    """Defined / mapped symbols and mapped columns per collection, then per-fold selected columns."""
    mapped = sets.join(genes, "symbol")
    defined = collection_sizes(sets).withColumnRenamed("set_size", "defined_symbols")
    found = mapped.groupBy("collection").agg(
        F.count_distinct("symbol").cast("bigint").alias("mapped_symbols"),
        F.count_distinct(feature).cast("bigint").alias("mapped_columns"),
    )
    panel = defined.join(found, "collection", "left").fillna(0)
    folds = selected.join(mapped.select("collection", feature).distinct(), feature).groupBy("model_fold", "collection").agg(
        F.count_distinct(feature).cast("bigint").alias("selected_columns")
    )
    return panel.unionByName(folds, allowMissingColumns=True)


def top_loadings(loadings: DataFrame, keys: list[str], value: str, feature: str, k: int) -> DataFrame:
    """k most negative and k most positive loadings per key, with rank and direction."""
    low = ranking.top_rows(loadings, keys, [F.asc(value), F.asc(feature)], k, "rank").withColumn("direction", F.lit("negative"))
    high = ranking.top_rows(loadings, keys, [F.desc(value), F.asc(feature)], k, "rank").withColumn("direction", F.lit("positive"))
    return low.unionByName(high)


def flag_counts(rows: DataFrame, row_key: str, column_key: str, columns: list[str], flag: Column) -> DataFrame:
    """Count of true flags, pivoted; missing combinations count 0."""
    return rows.groupBy(row_key).agg(
        *[F.count_if(flag & (F.col(column_key) == c)).alias(c) for c in columns]
    )


def symmetric_matrix(pairs: DataFrame, left: str, right: str, value: str, names: list[str]) -> DataFrame:
    """Upper-triangle pairs -> full matrix with unit diagonal (bounded by the name list)."""
    swapped = pairs.select(F.col(right).alias(left), F.col(left).alias(right), value)
    both = pairs.select(left, right, value).unionByName(swapped)
    ends = both.select(left).distinct().select(left, F.col(left).alias(right), F.lit(1.0).alias(value))
    return both.unionByName(ends).groupBy(left).pivot(right, names).agg(F.first(value))
