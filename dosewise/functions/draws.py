"""Deterministic draws from md5, so every resample can be replayed anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed: int | str, *parts: Column | str) -> Column:
    """Uniform hex key used to shuffle rows reproducibly."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


def draw_below(n: Column, seed: int | str, *parts: Column | str) -> Column:
    """Integer in [0, n) from the first 60 bits of the hash."""
    return order_number(seed, *parts) % n.cast("bigint")


def order_number(seed: int | str, *parts: Column | str) -> Column:
    """First 60 bits of the order hash: sorts like the hex text, as a number."""
    return F.conv(F.substring(order_hash(seed, *parts), 1, 15), 16, 10).cast("bigint")
