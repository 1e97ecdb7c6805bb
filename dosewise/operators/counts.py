"""Sparse counts -> cohort tables, pseudobulk profiles, response deltas, QC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import ranking
from dosewise.session import pinned

# Cohort and QC thresholds.
MIN_CELLS = 20
GROUP_THRESHOLDS = (10, 20, 30)
MATCHED_GROUPS = 10
QC_MIN_TOTAL = 100
QC_MIN_ENTITIES = 10
# Dense rows (keys times dictionary) of one part.
DENSE_ROWS_A_PART = 500_000


def normal_cells(cells: DataFrame, quality: str = "quality", keep: str = "normal") -> DataFrame:
    return cells.where(F.col(quality) == keep)


def tagged_cells(cells: DataFrame, tag: str, quality: str = "quality", ids: DataFrame | None = None) -> DataFrame:
    """Good cells whose tag parses, optionally limited to listed entities (semi join)."""
    kept = (
        normal_cells(cells, quality)
        .withColumn("condition", S.tag_condition(tag))
        .withColumn("hour", S.tag_hour(tag))
        .where(F.col("condition").isNotNull())
    )
    return kept if ids is None else kept.join(ids, "entity", "left_semi")


def select_cells(counts: DataFrame, cells: DataFrame, key: str = "cell") -> DataFrame:
    """Rows of the chosen cells only; the order is whatever explicit key `cells` carries."""
    return counts.join(cells, key, "left_semi")


def pseudobulk(counts: DataFrame, keys: list[str], feature: str = "feature", x: str = "x") -> DataFrame:
    """Exact integer sums per (keys, feature); partial sums run before the shuffle."""
    return counts.groupBy(*keys, feature).agg(F.sum(x).cast("bigint").alias("total"))


def cells_per_group(cells: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    return cells.groupBy(*keys).agg(F.count_distinct(cell).alias("n_cells"))


def with_library(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Add the library size; the group is one profile, at most one row per feature."""
    return profile.withColumn("library_size", F.sum("total").over(Window.partitionBy(*keys)))


def dense_parts(df: DataFrame, groups: int, size: int) -> int:
    """Parts for rows that become `groups` dictionaries of `size` rows: more groups, more parts."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups * size // DENSE_ROWS_A_PART))


def normalised(profile: DataFrame, keys: list[str], together: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """log1p CPM per profile.

    `together` names a subset of the keys to partition by: the library window
    and every later aggregation that keeps those keys then share one shuffle.
    Rows are sums by now, so a partition key holds a few dictionaries at most.
    Give `parts` where dictionaries are made dense: parts that look small by
    their sums would be merged before they grow.
    """
    if together:
        profile = profile.repartition(parts, *together) if parts else profile.repartition(*together)
    sized = with_library(profile, keys)
    return sized.withColumn("log1p_cpm", S.log1p_cpm("total", "library_size"))


def densify(sparse: DataFrame, keys: list[str], index: str, size: int | Column, values: list[str]) -> DataFrame:
    """Add the implicit zeros: every key gets indices 1..size.

    The first row of each key emits the zeros, so the table is read once and no
    key is joined to the dictionary; the sums that merge them reuse the
    partitioning of the keys. A key holds at most one dictionary of rows.
    """
    types = dict(sparse.dtypes)
    bound = (F.lit(size) if isinstance(size, int) else size).cast("int")
    own = F.array(F.lit(0))
    lead = F.row_number().over(Window.partitionBy(*keys).orderBy(index)) == 1
    slots = F.explode(F.when(F.col("_lead"), F.concat(own, F.sequence(F.lit(1), bound))).otherwise(own))
    rows = sparse.select(*keys, index, *values, lead.alias("_lead")).withColumn("_slot", slots)
    kept = F.col("_slot") == 0
    filled = rows.select(
        *keys,
        F.when(kept, F.col(index).cast("int")).otherwise(F.col("_slot")).alias(index),
        *[F.when(kept, F.col(v)).otherwise(F.lit(0).cast(types[v])).alias(v) for v in values],
    )
    return filled.groupBy(*keys, index).agg(*[F.sum(v).alias(v) for v in values])


def condition_delta(
    profiles: DataFrame, keys: list[str], value: str,
    condition: str = "condition", treated: str = "treated", control: str = "control",
) -> DataFrame:
    """Treated minus control per key in one aggregation; absent features are zeros.

    Keys without both conditions are the caller's error to check (`require_pairs`).
    """
    def side(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(condition) == name, F.col(value))), F.lit(0.0))

    return (
        profiles.where(F.col(condition).isin(treated, control))
        .groupBy(*keys)
        .agg(side(control).alias("control"), side(treated).alias("treated"))
        .withColumn("delta", F.col("treated") - F.col("control"))
    )


def paired_keys(profiles: DataFrame, keys: list[str], condition: str = "condition",
                treated: str = "treated", control: str = "control") -> DataFrame:
    """Keys that own both a treated and a control profile."""
    return (
        profiles.groupBy(*keys)
        .agg(F.bool_or(F.col(condition) == treated).alias("t"), F.bool_or(F.col(condition) == control).alias("c"))
        .where("t and c").select(*keys)
    )


def require_pairs(profiles: DataFrame, keys: list[str], condition: str = "condition", treated: str = "treated", control: str = "control") -> DataFrame:
    """The profiles, once every key is known to have both conditions; a one-sided key is an error."""
    count_pairs(profiles, keys, condition, treated, control)
    return profiles


def count_pairs(profiles: DataFrame, keys: list[str], condition: str = "condition", treated: str = "treated", control: str = "control") -> int:
    """Number of keys that have one of the conditions; a key with only one of them is an error."""
    sided = profiles.where(F.col(condition).isin(treated, control))
    sides = sided.groupBy(*keys).agg(F.count_distinct(condition).alias("sides"))
    total, lone = sides.agg(F.count(F.lit(1)), F.count_if(F.col("sides") < 2)).first()
    if lone:
        found = sides.where("sides < 2").select(*keys).take(3)
        raise ValueError(f"keys without both {treated} and {control}: {[tuple(r) for r in found]}")
    return total


def condition_counts(cells: DataFrame, key: str, label: str, names: list[str]) -> DataFrame:
    """Cells per key and condition label as columns; a missing label counts 0."""
    return cells.groupBy(key).agg(
        *[F.count_if(F.col(label) == n).cast("bigint").alias(n) for n in names]
    )


def cohort_flags(counts: DataFrame, early: str, late: str, treated: str, minimum: int = MIN_CELLS) -> DataFrame:
    """Strict and pooled eligibility from the three count columns."""
    pooled = F.col(early) + F.col(late)
    return (
        counts.withColumn("control_pooled", pooled)
        .withColumn("strict_eligible", (F.col(late) >= minimum) & (F.col(treated) >= minimum))
        .withColumn("pooled_eligible", (pooled >= minimum) & (F.col(treated) >= minimum))
    )


def group_eligibility(
    groups: DataFrame, key: str, thresholds: tuple[int, ...] = GROUP_THRESHOLDS,
    expected: int = MATCHED_GROUPS, condition: str = "condition", n_cells: str = "n_cells",
) -> DataFrame:
    """One boolean per threshold: all matched groups exist and each has enough cells."""
    matched = groups.where(F.col(condition) != "untreated").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_groups"), F.min(n_cells).alias("min_cells")
    )
    return matched.select(
        key, "n_groups", "min_cells",
        *[
            ((F.col("n_groups") == expected) & (F.col("min_cells") >= t)).alias(f"eligible_t{t}")
            for t in thresholds
        ],
    )


def cell_qc(counts: DataFrame, cells: DataFrame, marked: Column, cell_keys: list[str], source: str) -> DataFrame:
    """Per-source summary of per-cell library size, detected features, marked fraction."""
    per_cell = counts.groupBy(*cell_keys).agg(
        F.sum("x").alias("library"),
        F.count(F.lit(1)).alias("detected"),
        F.sum(F.when(marked, F.col("x")).otherwise(0)).alias("marked"),
    )
    measures = ["library", "detected", "marked_fraction"]
    filled = cells.join(per_cell, cell_keys, "left").select(
        source,
        F.coalesce("library", F.lit(0)).cast("double").alias("library"),
        F.coalesce("detected", F.lit(0)).cast("double").alias("detected"),
        S.ratio("marked", "library", empty=0.0).alias("marked_fraction"),
    )
    # one row per cell; three spreads are read from it
    filled = pinned(filled)
    base = filled.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("library") == 0).alias("zero_library")
    )
    largest = base.agg(F.max("n_cells")).first()[0] or 0
    wanted = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    spread = ranking.quantiles(
        filled.unpivot([source], measures, "measure", "value"), [source, "measure"], "value", wanted, largest=largest
    )
    wide = spread.groupBy(source).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(n))).alias(f"{m}_{n}") for m in measures for n in wanted
    ])
    return base.join(wide, source)


def control_feature_mask(
    control: DataFrame, feature: str = "feature", hour: str = "hour", early: int = 6, late: int = 24,
    min_total: int = QC_MIN_TOTAL, min_entities: int = QC_MIN_ENTITIES,
) -> DataFrame:
    """Features with enough control counts, seen in enough entities at both hours."""
    def seen(h: int) -> Column:
        return F.count_if((F.col(hour) == h) & (F.col("total") > 0))

    return (
        control.where(F.col(hour).isin(early, late))
        .groupBy(feature)
        .agg(F.sum("total").cast("bigint").alias("total"), seen(early).alias("n_early"), seen(late).alias("n_late"))
        .where((F.col("total") >= min_total) & (F.col("n_early") >= min_entities) & (F.col("n_late") >= min_entities))
    )


def compare_vectors(pairs: DataFrame, keys: list[str], left: str, right: str, ranks: bool = False,
                    largest: int | None = None, third: str | None = None) -> DataFrame:
    """RMSE, Pearson, cosine (and Spearman) between two value columns per key; `treated_rmse` of right and third."""
    aggs = [
        S.rmse(left, right).alias("rmse"), S.pearson(left, right).alias("pearson"), S.cosine(left, right).alias("cosine"),
        *([S.rmse(right, third).alias("treated_rmse")] if third else []),
    ]
    rows = pairs
    if ranks:
        rows = ranking.average_rank(rows, keys, left, "_rl", largest)
        rows = ranking.average_rank(rows, keys, right, "_rr", largest)
        aggs.append(S.pearson("_rl", "_rr").alias("spearman"))
    return rows.groupBy(*keys).agg(*aggs)
