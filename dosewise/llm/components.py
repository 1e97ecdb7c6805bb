"""Connected components of a link table by alternating star contractions.

Every pass replaces the links by ones that lead to smaller nodes. Neighbour minima are hash aggregates (combined before
the shuffle) joined back to the links, so a node with many links is split by the join and no group meets in one task.
The links are checkpointed after each pass; only one row (count and checksum) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.session import pinned


def _state(links: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), digest).first())


def _link(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows.

    Both directions come from one read: a union of two reads of a checkpointed table can break the optimizer.
    """
    both = links.select(F.explode(F.array(_link("a", "b"), _link("b", "a"))).alias("link")).select("link.*")
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.explode(F.array(_link("b", "m"), _link("a", "m"))).alias("link")).select("link.*")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.

    `links` has two columns of one orderable type, `a` and `b`; direction, repeats and self links do not matter, links
    with a null end are ignored.
    """
    links = pinned(links.select("a", "b").where("a != b").distinct())
    before = None
    while (now := _state(links)) != before:
        before = now
        links = pinned(_small_star(_large_star(links).distinct()).where("a != b").distinct())
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = F.explode(F.array(F.col("node"), F.col("root")))
    return roots.select(own.alias("node"), "root").distinct()
