"""Column profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import ranking

EXAMPLES = 20


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """dtype, distinct non-null count, null count and the first 20 distinct values per column.

    Values are folded to distinct (column, value) pairs first, so no task holds
    one column's values; examples are taken by a limited rank.
    """
    names = columns or df.columns
    types = dict(df.dtypes)
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "column", "value")
    counted = tall.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    facts = counted.groupBy("column").agg(
        F.count("value").alias("n_distinct"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = ranking.top_rows(counted.where("value is not null"), ["column"], [F.asc("value")], EXAMPLES)
    examples = first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    kinds = F.create_map(*[F.lit(v) for c in names for v in (c, types[c])])
    return facts.join(examples, "column", "left").select(
        "column", F.element_at(kinds, F.col("column")).alias("dtype"), "n_distinct", "n_null", "examples"
    )
