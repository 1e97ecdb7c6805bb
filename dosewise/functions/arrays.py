"""Array-layout vector expressions (one row per vector)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dosewise.functions.scalar import col


def doubles(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def subtract(left: Column | str, right: Column | str) -> Column:
    return F.zip_with(doubles(left), doubles(right), lambda a, b: a - b)


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(doubles(left), doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(vector: Column | str) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column | str, right: Column | str) -> Column:
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def squared_distance(left: Column | str, right: Column | str) -> Column:
    diffs = F.zip_with(doubles(left), doubles(right), lambda a, b: (a - b) * (a - b))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def leading(vector: Column | str, size: int) -> Column:
    return F.slice(doubles(vector), 1, size)
