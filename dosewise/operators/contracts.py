"""Data-quality contracts: every rule yields (rule, violations); a report passes when all are 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fact(df: DataFrame, rule: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def unique_key(df: DataFrame, keys: list[str], rule: str = "unique_key") -> DataFrame:
    repeats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return fact(repeats, rule, F.count_if(F.col("n") != 1))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def schema_matches(df: DataFrame, schema: StructType) -> bool:
    have = {f.name: f.dataType for f in df.schema}
    return all(have.get(f.name) == f.dataType for f in schema)


def not_null(df: DataFrame, columns: list[str], rule: str = "not_null") -> DataFrame:
    return fact(df, rule, F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])))


def complete_grid(df: DataFrame, outer: str, inner: list[str], rule: str = "complete_grid") -> DataFrame:
    """Every `outer` value owns every `inner` combination.

    Counted, not generated: a value is incomplete when its distinct inner
    combinations are fewer than those of the whole table.
    """
    whole = df.agg(F.count_distinct(*inner).alias("_all")).withColumn("_k", F.lit(1))
    own = df.groupBy(outer).agg(F.count_distinct(*inner).alias("_own")).withColumn("_k", F.lit(1))
    return fact(own.join(F.broadcast(whole), "_k"), rule, F.count_if(F.col("_own") != F.col("_all")))


def expected_count(df: DataFrame, expected: int, rule: str = "row_count") -> DataFrame:
    return fact(df, rule, F.abs(F.count(F.lit(1)) - expected))


def expected_distinct(df: DataFrame, columns: list[str], expected: int, rule: str = "distinct_count") -> DataFrame:
    return fact(df, rule, F.abs(F.count_distinct(*columns) - expected))


def within_tolerance(stored: DataFrame, computed: DataFrame, keys: list[str], value: str, tolerance: float,
                     rule: str = "recomputed") -> DataFrame:
    """Stored and recomputed values agree; a key present on one side only is a violation."""
    a = stored.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = computed.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    both = a.join(b, keys, "full_outer")
    differ = (F.abs(F.col("_a") - F.col("_b")) > tolerance) | (F.col("_a").isNull() != F.col("_b").isNull())
    bad = F.col("_ina").isNull() | F.col("_inb").isNull() | F.coalesce(differ, F.lit(False))
    return fact(both, rule, F.count_if(bad))


def disjoint(left: DataFrame, right: DataFrame, keys: list[str], rule: str = "no_leakage") -> DataFrame:
    shared = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")
    return fact(shared, rule, F.count(F.lit(1)))


def same_set(left: DataFrame, right: DataFrame, keys: list[str], rule: str = "same_set") -> DataFrame:
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    odd = a.join(b, keys, "left_anti").unionByName(b.join(a, keys, "left_anti"))
    return fact(odd, rule, F.count(F.lit(1)))


def all_true(df: DataFrame, predicate: Column, rule: str) -> DataFrame:
    """NULL counts as a violation."""
    return fact(df, rule, F.count_if(~F.coalesce(predicate, F.lit(False))))


def functional_dependency(df: DataFrame, key: str, value: str, rule: str = "one_id_per_key") -> DataFrame:
    return fact(df.groupBy(key).agg(F.count_distinct(value).alias("n")), rule, F.count_if(F.col("n") > 1))


def exactly_one_match(wanted: DataFrame, rows: DataFrame, key: str, rule: str = "exactly_one_match") -> DataFrame:
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return fact(wanted.join(found, key, "left"), rule, F.count_if(F.coalesce(F.col("n"), F.lit(0)) != 1))


def not_empty(df: DataFrame, rule: str = "not_empty") -> DataFrame:
    return fact(df, rule, F.when(F.count(F.lit(1)) == 0, 1).otherwise(0))


def same_dictionary(left: DataFrame, right: DataFrame, index: str, ident: str, rule: str = "same_dictionary") -> DataFrame:
    """Two ordered dictionaries hold the same id at every index."""
    a = left.select(index, F.col(ident).alias("_a"))
    b = right.select(index, F.col(ident).alias("_b"))
    return fact(a.join(b, index, "full_outer"), rule, F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))))


def non_increasing(df: DataFrame, order: str, value: str, keys: list[str] | None = None, rule: str = "monotone") -> DataFrame:
    """Cohort sizes may not grow with the threshold (a report-sized table)."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    return fact(df.withColumn("_p", F.lag(value).over(w)), rule, F.count_if(F.col(value) > F.col("_p")))


def named_values(documents: list[DataFrame], expected: DataFrame, rule: str = "scalar_contract") -> DataFrame:
    """(name, value) documents agree with the expected values."""
    checks = [within_tolerance(expected, d, ["name"], "value", 0.0, rule) for d in documents]
    return reduce(DataFrame.unionByName, checks).groupBy("rule").agg(F.sum("violations").alias("violations"))


def report(facts: list[DataFrame]) -> DataFrame:
    """All rules in one table with a verdict."""
    return reduce(DataFrame.unionByName, facts).withColumn("passed", F.col("violations") == 0)


def stages_passed(reports: DataFrame, status: str = "status", passed: str = "passed") -> DataFrame:
    return reports.agg(F.bool_and(F.col(status) == passed).alias("all_passed"), F.count(F.lit(1)).alias("stages"))


def require(facts: DataFrame) -> None:
    """Raise with the failing rules (a report has one row per rule)."""
    failed = facts.where(F.col("violations") > 0).limit(100).collect()
    if failed:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in failed))
