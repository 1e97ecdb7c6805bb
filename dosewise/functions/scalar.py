"""Scalar, string and guarded numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample-tag grammar, condition names, measurement hours, periods.
TAG_PATTERN = r"^(DMSO|Tram|Untreated)_(3|6|12|24|48)hr$"
TAG_CONDITIONS = {"DMSO": "control", "Tram": "treated", "Untreated": "untreated"}
HOURS = (3, 6, 12, 24, 48)
EARLY_HOURS = (3, 6)
LATE_HOURS = (24, 48)
UNTREATED_HOUR = 48
CPM_SCALE = 1e6
NRMSE_FLOOR = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str, empty: float | None = None) -> Column:
    """Division that yields `empty` instead of failing on a zero denominator."""
    value = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def log1p_cpm(count: Column | str, library: Column | str) -> Column:
    return F.log1p(col(count).cast("double") * CPM_SCALE / col(library).cast("double"))


def literal_map(key: Column | str, mapping: dict) -> Column:
    """Literal lookup; a key outside the mapping gives NULL."""
    branches = None
    for name, value in mapping.items():
        test = col(key) == F.lit(name)
        branches = F.when(test, F.lit(value)) if branches is None else branches.when(test, F.lit(value))
    return branches


def tag_condition(tag: Column | str) -> Column:
    prefix = F.regexp_extract(col(tag), TAG_PATTERN, 1)
    hour = F.regexp_extract(col(tag), TAG_PATTERN, 2)
    misplaced = (prefix == "Untreated") & (hour != str(UNTREATED_HOUR))
    return F.when(~misplaced, literal_map(prefix, TAG_CONDITIONS))


def tag_hour(tag: Column | str) -> Column:
    hour = F.regexp_extract(col(tag), TAG_PATTERN, 2)
    return F.when(tag_condition(tag).isNotNull(), hour.try_cast("int"))


def tag_text(condition: Column | str, hour: Column | str) -> Column:
    """Inverse of the tag parser."""
    prefix = literal_map(condition, {v: k for k, v in TAG_CONDITIONS.items()})
    return F.concat(prefix, F.lit("_"), col(hour).cast("string"), F.lit("hr"))


def period(hour: Column | str) -> Column:
    h = col(hour)
    return F.when(h.isin(*EARLY_HOURS), "early").when(h.isin(*LATE_HOURS), "late").otherwise("middle")


def over_threshold(value: Column | str, threshold: float) -> Column:
    """value > threshold where an undefined value counts as false."""
    v = col(value).cast("double")
    return F.coalesce(~F.isnan(v) & (v > threshold), F.lit(False))


def is_finite(*values: Column | str) -> Column:
    test = F.lit(True)
    for value in values:
        v = col(value).cast("double")
        test = test & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return test


def first_match(flags: list[tuple[Column | str, str]], default: str) -> Column:
    """Label of the first true flag."""
    chain = None
    for flag, label in flags:
        chain = F.when(col(flag), label) if chain is None else chain.when(col(flag), label)
    return chain.otherwise(default)


def ridge_parameter_count(dimension: Column | str, targets: Column | str) -> Column:
    return (col(dimension) + 1) * col(targets)


def low_rank_parameter_count(dimension: Column | str, rank: Column | str, targets: Column | str) -> Column:
    d, r = col(dimension), col(rank)
    return col(targets) * (r + 1) + r * (d + 1)


def text_sha256(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def ordered_join(values: Column, sep: str = ";") -> Column:
    """Sorted unique strings joined by a separator (aggregate over bounded sets)."""
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


# --- aggregate expressions ------------------------------------------------

def rmse(observed: Column | str, predicted: Column | str) -> Column:
    return F.sqrt(F.avg(F.pow(col(predicted) - col(observed), 2)))


def rms(value: Column | str) -> Column:
    return F.sqrt(F.avg(F.pow(col(value), 2)))


def nrmse(observed: Column | str, predicted: Column | str) -> Column:
    return rmse(observed, predicted) / F.greatest(rms(observed), F.lit(NRMSE_FLOOR))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over rows where both sides are present; NULL when a side is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    constant = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y)) | (F.count(x) == 0)
    return F.when(
        ~constant, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    )


def cosine(x: Column | str, y: Column | str) -> Column:
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y)))


def fraction(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
